"""DuckDB SQL of the queries that SQL can express, written from the definitions.

Tables of constants (word lists, sentences, rules) are shared with the operators,
as they are part of the definition; the logic is SQL's own.
"""

from __future__ import annotations

from barloom.llm import licenses, quality, secrets

GAP = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '')"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TOP_K = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def _secrets() -> str:
    kinds = [("assign", secrets.ASSIGN, "length(regexp_extract_all(t, {p}, 2)[i]) >= 12"), ("access", secrets.ACCESS, "length(m[i]) >= 18"),
             ("hex", "[0-9a-f]+", "length(m[i]) >= 16")]
    for name, (pattern, must, *_) in secrets.CLASSES.items():
        fits = " AND ".join(f"regexp_matches(m[i], {_q(p)})" for p in (*must, secrets.NOT_PLAIN))
        allowed = " OR ".join(f"regexp_matches(m[i], {_q(p)})" for p in secrets.ALLOWED)
        kinds.append((name, pattern, f"length(m[i]) >= {secrets.WINDOW} AND {fits} AND NOT ({allowed})"))
    parts = []
    for k, (name, pattern, keep) in enumerate(kinds):
        p = _q(pattern)
        parts.append(f"""{name} AS (SELECT doc_id, {k} AS k, i, m[i] AS x, s, s + length(m[i]) AS e, {keep.replace("{p}", p)} AS keep FROM (
    SELECT doc_id, t, m, unnest(range(1, len(m) + 1)) AS i, CAST(list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS s
    FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p}))))""")
    weights = "[" + ", ".join(map(str, secrets.WEIGHTS)) + "]"
    n = secrets.WINDOW
    names = "[" + ", ".join(map(_q, secrets.KINDS)) + "]"
    same = lambda k: "lower(x)" if k in secrets.LOWERED else "translate(x, {}, {})".format(*map(_q, secrets.TRANSLATED))
    cand = " UNION ALL ".join(f"SELECT doc_id, k, i, s, {same(k)} AS x, {secrets.most_weight(c[3])} AS most FROM {k} WHERE keep" for k, c in secrets.CLASSES.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {', '.join(parts)},
  cand AS ({cand}),
  win AS (SELECT doc_id, k, i, s, most, o, string_split(substr(x, o + 1, {n}), '') AS c FROM (SELECT *, unnest(range(0, length(x) - {n - 1})) AS o FROM cand)),
  hit AS (SELECT doc_id, k, i, s, o FROM win WHERE list_sum(list_transform(list_distinct(c), lambda u: {weights}[len(list_filter(c, lambda y: y = u)) + 1])) <= most),
  isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, k, i ORDER BY o) AS g FROM (SELECT *, CASE WHEN o <= lag(o) OVER (PARTITION BY doc_id, k, i ORDER BY o) + {n} THEN 0 ELSE 1 END AS new FROM hit)),
  spans AS (SELECT doc_id, k, s, e FROM assign WHERE keep UNION ALL SELECT doc_id, k, s, e FROM access WHERE keep UNION ALL SELECT doc_id, k, s, e FROM hex WHERE keep
    UNION ALL SELECT doc_id, k, min(s + o), max(s + o) + {n} FROM isl GROUP BY doc_id, k, i, g),
  l AS (SELECT doc_id, k, {names}[k + 1] || ':' || s || ':' || e AS x, s, e FROM spans)
  SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    sha256(coalesce(string_agg(x, ',' ORDER BY s, k, e) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k, e), '') AS spans
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY d.doc_id"""


SUBSTRING = f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
  f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM g) WHERE first < doc_id),
  c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM f) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
  FROM d LEFT JOIN c ON d.doc_id = c.doc_id"""


def _quality() -> str:
    known = "[" + ", ".join(map(_q, quality.COMMON_WORDS)) + "]"
    length_of = lambda p: f"length(regexp_replace(t, {_q(p)}, '', 'g'))"
    classes = [length_of(p) for p in quality.CLASSES.values()]
    chars = ", ".join([*classes, "n_symbols", "length(t) - word_chars", f"word_chars - n_symbols - ({' + '.join(classes)})"])
    commons = ", ".join(f"len(list_filter(w, lambda x: x = {_q(k)}))" for k in quality.COMMON_WORDS)
    n_chars, n_words = len(quality.CLASSES) + 3, len(quality.COMMON_WORDS) + 1
    array = lambda first, n: f"CASE WHEN max(step) FILTER (class = {first}) IS NOT NULL THEN [" + ", ".join(
        f"max(step) FILTER (class = {i})" for i in range(first, first + n)) + "] END"
    steps = lambda c, first, enough: (
        f"SELECT lang, source, unnest(range({first}, {first} + len({c}))) AS class, unnest(list_transform({c}, lambda x: CAST(round({quality.GRID} * "
        f"(CASE WHEN list_sum({c}) > 0 THEN CAST(x AS DOUBLE) / list_sum({c}) ELSE 0 END)) AS BIGINT))) AS step FROM judged WHERE {enough}")

    def jsd(p: str, q: str) -> str:
        share = lambda a: f"(CASE WHEN list_sum({a}) > 0 THEN CAST({a}[i] AS DOUBLE) / list_sum({a}) ELSE 0 END)"
        part = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * log2(2.0::DOUBLE * {x} / ({x} + {y})) ELSE 0 END)"
        return f"round(sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(share(p), share(q))} + {part(share(q), share(p))})) / 2)), 9)"

    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
  lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
  rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
  a AS (SELECT d.doc_id, lang, source, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST({length_of(quality.SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
    FROM d JOIN lines USING (doc_id) LEFT JOIN rep ON rep.doc_id = d.doc_id),
  h AS (SELECT *, [{chars}] AS hc, list_append([{commons}], n_words - len(list_filter(w, lambda x: list_contains({known}, x)))) AS hw,
    n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM a),
  judged AS (SELECT lang, source, length(t) AS n_chars, n_words, hc, hw FROM h WHERE NOT base_failed AND (length(t) >= {quality.GUARD_CHARS} OR n_words >= {quality.GUARD_WORDS})),
  origins AS (SELECT lang AS ol, source AS os, count(*) AS n FROM judged GROUP BY lang, source),
  weights AS (SELECT ol, os, CAST(ceil({quality.WEIGHT} * least(1.0::DOUBLE, CAST(avg(n) OVER (PARTITION BY ol) AS DOUBLE) / n)) AS BIGINT) AS weight FROM origins),
  steps AS ({steps('hc', 0, f"n_chars >= {quality.GUARD_CHARS}")} UNION ALL {steps('hw', n_chars, f"n_words >= {quality.GUARD_WORDS}")}),
  held AS (SELECT lang, class, step, sum(weight) AS weight FROM steps JOIN weights ON lang IS NOT DISTINCT FROM ol AND source IS NOT DISTINCT FROM os GROUP BY lang, class, step),
  upto AS (SELECT *, sum(weight) OVER (PARTITION BY lang, class ORDER BY step) AS below, sum(weight) OVER (PARTITION BY lang, class) AS total FROM held),
  medians AS (SELECT lang, class, min(step) AS step FROM upto WHERE 2 * below >= total GROUP BY lang, class),
  r AS (SELECT lang AS rl, {array(0, n_chars)} AS rc, {array(n_chars, n_words)} AS rw FROM medians GROUP BY lang),
  j AS (SELECT *, {jsd('hc', 'rc')} AS dc, {jsd('hw', 'rw')} AS dw FROM h LEFT JOIN r ON lang IS NOT DISTINCT FROM rl)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
    AND NOT coalesce(length(t) >= {quality.GUARD_CHARS} AND dc > {quality.MAX_CHAR_DISTANCE}, false)
    AND NOT coalesce(n_words >= {quality.GUARD_WORDS} AND dw > {quality.MAX_WORD_DISTANCE}, false) AS kept FROM j"""


def _licenses() -> str:
    known = ", ".join(f"({_q(s)}, {_q(name)})" for name, all_ in licenses.SENTENCES.items() for s in all_)
    normal = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9.-]+', ' ', 'g'), ' .-')"
    chain = "coalesce(array_to_string(list_transform(ids, lambda x: ';' || x || ';'), ''), '')"
    for name, ids in licenses.RULES:
        chain = f"replace({chain}, {_q(''.join(f';{x};' for x in ids))}, '<{name}>')"
    b, c, s = (_q(x.replace("\\n", "\n")) for x in (licenses.BREAK, licenses.COPYRIGHT, licenses.STOP))
    return f"""WITH known(sentence, id) AS (VALUES {known}),
  d AS (SELECT doc_id, CASE WHEN regexp_matches(text, {_q(licenses.TRIGGER)}) THEN text END AS t FROM documents),
  raw AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM (
    SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(t, {b}, chr(10), 'g'), '\\n\\n+', '.' || chr(10), 'g'), {c}, '\\1.' || chr(10), 'g'), {s}) AS x FROM d WHERE t IS NOT NULL)),
  one AS (SELECT doc_id, i, CASE WHEN {normal('x')} IN (SELECT sentence FROM known) THEN [{normal('x')}] ELSE list_transform(string_split(x, chr(10)), lambda y: {normal('y')}) END AS l FROM raw),
  part AS (SELECT doc_id, i, generate_subscripts(l, 1) AS j, unnest(l) AS x FROM one),
  n AS (SELECT doc_id, list(id ORDER BY i, j) FILTER (id IS NOT NULL) AS ids, count(*) FILTER (id IS NULL AND regexp_matches(x, 'licen[sc]e')) AS unknown FROM part LEFT JOIN known ON x = sentence GROUP BY doc_id),
  e AS (SELECT d.doc_id, coalesce(ids, []) AS ids, coalesce(unknown, 0) AS unknown, list_concat(regexp_extract_all({chain}, '<([^>]+)>', 1), coalesce(regexp_extract_all(t, {_q(licenses.TAG)}, 1), [])) AS found FROM d LEFT JOIN n ON n.doc_id = d.doc_id)
  SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS licenses, CAST(unknown AS BIGINT) AS n_unknown FROM e"""


WARC = """WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, coalesce(html, '') AS x FROM pages),
  f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
  SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (d // 8) AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (d % 8) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

ORACLE = {"op2_exact_top_k": TOP_K, "op4_secret_scans": _secrets(), "op5_substring_dedup": SUBSTRING, "op8_license_scans": _licenses(),
          "op9_quality_rules": _quality(), "op10_warc": WARC}
