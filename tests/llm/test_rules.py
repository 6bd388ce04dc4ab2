"""Quality rules, licences, packing, archive and search against brute-force versions."""

import base64
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import licenses, packing, quality, vafile, warc
from barloom.llm.sql import ORACLE

WORD = "[^\x20\x09-\x0D]+"


def plain_counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    twice = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_quality_counts_and_guards(spark):
    rng = random.Random(1)
    parts = ["the", "of", "x#", "a|b", "\n", "\n\n", "é\U0001F600", "\t", "12", "Word,", "\xa0"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 80))), rng.choice(["en", "fr", None])) for i in range(200)]
    rows += [(900, None, "en"), (901, "", None), (902, " \n", "en"), (903, "a b c d e f g h i " * 2000, "en"), (None, "x " * 30, "en"), (5, rows[5][1], rows[5][2]),
             (904, "%%%### " * 200, "en"), (905, "&&&***", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("w", F.lit(1)).withColumn("kept", F.lit("x"))
    got = sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()))
    want = []
    for i, t, _ in rows:
        n, c, s, d, twice = plain_counts(t)
        want.append((str(i), n, c, s, d, twice, n < 20 or 100 * twice > 30 * n))
    assert got == sorted(want)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns
    assert quality.quality(docs.where("false")).count() == 0


def test_distance_to_the_language_rejects_symbol_text_only_beyond_the_guard(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "and", "to", "in", "house", "stone", "river", "walks", "bright"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    odd = lambda n: " ".join(rng.choice(vocab) + rng.choice(["###", "%%%", "$$$"]) * 3 for _ in range(n))
    rows = [(i, text(150), "en") for i in range(40)] + [(100, odd(150), "en"), (101, odd(25), "en"), (102, text(25), "en")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100].base_failed and not got[100].kept and got[100].char_distance > got[0].char_distance
    assert got[101].kept and got[102].kept and all(got[i].kept for i in range(40))


def test_accepted_does_not_move_texts_however_many_rows_are_rejected(spark):
    rng = random.Random(7)
    vocab = ["the", "of", "and", "to", "in", "house", "stone", "river", "walks", "bright"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(150)), "en") for i in range(40)] + [(100 + i, f"short {i}", "en") for i in range(5000)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40000")  # the keys of the rejected rows take more
    try:
        kept = quality.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in kept.collect()} == set(range(40))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("junk", ["caps", "symbols", "giant"])
def test_a_hot_source_of_junk_does_not_move_the_reference(spark, junk):
    rng = random.Random(6)
    vocab = ["the", "of", "and", "to", "in", "house", "stone", "river", "walks", "bright"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    odd = {"caps": lambda: text(200).upper(), "symbols": lambda: " ".join(rng.choice(vocab) + "###" * 3 for _ in range(200)), "giant": lambda: text(9000).upper()}[junk]
    rows = [(i, text(200), "en", f"s{i % 6}") for i in range(60)] + [(100 + i, odd(), "en", "hot") for i in range(3 if junk == "giant" else 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if r.kept} == set(range(60))
    assert {r.doc_id for r in quality.accepted(docs).collect()} == set(range(60))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    assert {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLE['op9_quality_rules']}) WHERE kept").fetchall()} == set(range(60))


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE = """Copyright (c) 2020 X
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licences(spark):
    rows = [(1, MIT, "MIT"), (2, APACHE, "Apache-2.0"), (3, APACHE.replace("\n", "\n# "), "Apache-2.0"), (4, None, ""), (5, "", ""), (6, "Nothing here. At all", ""),
            (7, "Some words\nReleased under the MIT License.\nmore words", "MIT"), (8, "# SPDX-License-Identifier: MPL-2.0\nx", "MPL-2.0"),
            (9, "Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0,GPL-3.0-only"), (9, MIT, "MIT"), (None, MIT, "MIT")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("licenses", F.lit("x"))
    got = sorted((str(r.doc_id), r.licenses) for r in licenses.recognise(docs).collect())
    assert got == sorted((str(i), x) for i, _, x in rows)
    assert all(re.search(licenses.TRIGGER, s) for all_ in licenses.SENTENCES.values() for s in all_)
    names = {s for all_ in licenses.SENTENCES.values() for s in all_}
    assert len(names) == sum(map(len, licenses.SENTENCES.values())) and all(x in licenses.SENTENCES for _, ids in licenses.RULES for x in ids)


GPL = """This program is free software{stop} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{sep} either version {n} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: Public wordings of the other notices, each with the licence it names.
LESSER = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AFFERO = GPL.replace("GNU General", "GNU Affero General")
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/

The rest of the file."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""


def test_public_notices_with_stops_inside(spark):
    notices = [(LESSER, "LGPL-2.1-or-later"), (AFFERO.format(stop=":", sep=",", n=3), "AGPL-3.0-or-later"), (AFFERO.format(stop=";", sep=";", n=3), "AGPL-3.0-or-later"),
               (ZLIB, "Zlib"), (EPL, "EPL-2.0"), (BSD, "BSD-2-Clause"), (GPL.format(stop=":", sep=",", n=3), "GPL-3.0-or-later"), (GPL.format(stop=";", sep=";", n=2), "GPL-2.0-or-later"), (MPL, "MPL-2.0")]
    marked = [(mark + t.replace("\n", "\n" + mark), want) for t, want in notices for mark in ("", "# ", "// ", " * ")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(marked)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.recognise(docs).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: want for i, (_, want) in enumerate(marked)}
    assert all("gpl_warranty,gpl_implied,gpl_copy" in got[i].sentence_ids for i, (_, want) in enumerate(marked) if want.startswith("GPL"))
    assert all("bsd_as_is" in got[i].sentence_ids for i, (_, want) in enumerate(marked) if want.startswith("BSD"))


def test_packing_plan_places_every_piece_once():
    rng = random.Random(1)
    for _ in range(200):
        caps = sorted(rng.sample(range(4, 60), rng.randint(1, 4)))
        h = {rng.randint(1, max(caps)): rng.randint(1, 40) for _ in range(rng.randint(0, 30))}
        seen, used, size = set(), {}, {}
        for length, rank, count, first, offset, cap in packing.plan(h, caps, rng.choice([0, 3])):
            for i in range(count):
                assert (length, rank + i) not in seen
                seen.add((length, rank + i))
                cells = used.setdefault(first + i, set())
                assert not cells & set(range(offset, offset + length))
                cells |= set(range(offset, offset + length))
                assert size.setdefault(first + i, cap) == cap
        assert seen == {(x, i) for x, n in h.items() for i in range(n)}
        # gap-free from the start, and downsized to the smallest capacity that holds them
        assert all(cells == set(range(len(cells))) and size[b] == min(c for c in caps if c >= len(cells)) for b, cells in used.items())


def one_by_one(histogram, caps, overhead):
    """Best fit of single pieces, longest first: contents and final capacity of every bin."""
    bins, stacks, to_come = [], {}, sum(n * c for n, c in histogram.items())
    for length in sorted(histogram, reverse=True):
        to_come -= length * histogram[length]
        promised, capacity = 0, None  # bins still to open at the capacity chosen last
        for left in range(histogram[length], 0, -1):
            rooms = [room for room, x in stacks.items() if x and room >= length]
            if rooms:
                at = stacks[min(rooms)].pop()
            else:
                if not promised:
                    cost = {c: (c + overhead) / min(c, length * (c // length) + to_come / left) for c in caps if c >= length}
                    capacity = min(cost, key=lambda c: (cost[c], c))
                    promised = left // min(capacity // length, left)
                promised -= 1
                at = len(bins)
                bins.append([capacity, []])
            bins[at][1].append(length)
            stacks.setdefault(bins[at][0] - sum(bins[at][1]), []).append(at)
    return sorted((min(c for c in caps if c >= sum(x)), sorted(x)) for _, x in bins)


def test_packing_plan_is_best_fit_piece_by_piece():
    rng = random.Random(4)
    for _ in range(300):
        caps = sorted(rng.sample(range(4, 60), rng.randint(1, 4)))
        h = {rng.randint(1, max(caps)): rng.randint(1, 30) for _ in range(rng.randint(0, 20))}
        overhead = rng.choice([0, 3, 16])
        bins = {}
        for length, _, count, first, _, cap in packing.plan(h, caps, overhead):
            for i in range(count):
                bins.setdefault(first + i, (cap, []))[1].append(length)
        assert sorted((c, sorted(x)) for c, x in bins.values()) == one_by_one(h, caps, overhead)


def test_packing_breaks_ties_by_document(spark):
    rows = [(i, 4) for i in random.Random(1).sample(range(40), 40)] + [(None, 4), (7, 4), (50, 23)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, size int").repartition(5), [8]).where("length = 4").collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.bin_offset, r.bin))]
    assert len(order) == 42 and order == [None, *sorted([*range(40), 7])]
    long = packing.pack(spark.createDataFrame([(1, 1_000_003)], "doc_id long, size int"), [8, 16]).collect()
    assert sum(r.length for r in long) == 1_000_003 and len({(r.bin, r.bin_offset) for r in long}) == len(long) == 62_501


def test_packing_of_a_table(spark):
    rows = [(i, "w " * n) for i, n in enumerate([5, 5, 9, 3, 1, 30, 8, 16, 17, 0])] + [(5, "x " * 7), (None, "a b"), (77, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("x")).withColumn("bin", F.lit(0))
    got = packing.pack(packing.by_words(docs), [8, 16], 1).collect()
    bins = {}
    for r in got:
        bins.setdefault((r.bin, r.bin_capacity), []).append((r.bin_offset, r.length))
    assert sum(r.length for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert len({b for b, _ in bins}) == len(bins)
    for (_, cap), parts in bins.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= cap
    assert packing.pack(packing.by_words(docs.where("false")), [8]).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "u", "<p>é</p>"), (2, "v\r\nw", "<p>é</p>"), (3, None, ""), (4, "x", None), (0, "y", "only"), (None, "z", "only"), (2, "v", "<p>é</p>"), (None, None, "solo"), (1, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1)).withColumn("n", F.lit("x"))
    for least in (0, 3):
        path = f"{tmp_path}/{least}"
        warc.write_archive(pages, path, least)
        record = warc.read_archive(spark, path)
        want = []
        for page, _, html in rows:
            data = (html or "").encode()
            same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
            first = min(same, default=None)
            revisit = len(data) >= least and first is not None and page != first
            want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
        assert sorted(map(tuple, warc.describe(record).collect()), key=str) == sorted(want, key=str)
        assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in rows})
        for r in warc.written(record).collect():  # each record parses on its own
            head, _, rest = bytes(r.data).partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and int(re.search(rb"Content-Length: (\d+)$", head)[1]) == len(rest) - 4 and rest.endswith(b"\r\n\r\n")
        bodies = sorted(bytes(r.data).partition(b"\r\n\r\n")[2] for r in warc.captured(record).collect())
        assert bodies == sorted((h or "").encode() for _, _, h in rows)


def test_archive_tells_altered_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    bad = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit("abd").cast("binary"))
    bad.write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="missing or altered"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


def test_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK", 32)
    rng = np.random.default_rng(2)
    base = [[float(x) for x in rng.integers(-3, 4, 4) / 1024.] for _ in range(5)]
    rows = [(i, base[rng.integers(0, 5)] if rng.random() < .8 else [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    rows += [(400, None), (500, [1.0, None, 0., 0.]), (600, [float("nan"), 0., 0., 0.]), (None, [1.] * 4), (700, [float("inf"), 0., 0., 0.])]
    for extra in ([], [(800, [1e12, -1e12, 3., 4.]), (801, [2e12, 1e12, 3., 4.])]):
        all_ = rows + extra
        docs = spark.createDataFrame(all_, "vec_id long, embedding array<double>").withColumn("id", F.lit(1)).withColumn("v", F.lit("x"))
        good = [(i, [math.floor(1024 * x) for x in v]) for i, v in all_ if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
        want = []
        for q, a in good:
            if q % 100 == 0:
                best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:10]
                want += [(q, r + 1, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
        assert sorted(map(tuple, vafile.top_k(docs, docs.where("vec_id % 100 = 0"), 10).collect())) == sorted(want)
    assert vafile.top_k(docs.where("false"), docs, 10).count() == 0
    few = docs.where("vec_id < 3")
    assert vafile.top_k(few, few.where("vec_id = 0"), 10).count() == 2


def test_archive_refuses_two_payloads_of_one_digest(spark):
    rows = [(b"one", "d1", "aa", 3), (b"one", "d1", "aa", 3), (b"two", "d2", "bb", 3), (b"twoo", "d2", "bb", 4)]
    df = spark.createDataFrame(rows, "payload binary, sha256 string, sha1 string, n long")
    assert [(r.sha256, bytes(r.payload)) for r in warc.stored_once(df.where("sha256 = 'd1'")).collect()] == [("d1", b"one")]
    with pytest.raises(Exception, match="two payloads of one digest"):
        warc.stored_once(df).select("payload").collect()
    with pytest.raises(Exception, match="two payloads of one digest"):
        warc.stored_once(df.withColumn("n", F.lit(3).cast("long")).withColumn("sha1", F.hex("payload"))).select("payload").collect()
