"""Secret scans: patterns, and entropy in a sliding window over candidate strings.

Three base patterns give spans. Besides, four character classes (hexadecimal digits,
letters of one case with digits, letters and digits, base 64) each have candidates:
the longest runs of the class's own characters. A window slides over a candidate; the
counts of the class's symbols and the sum of c*log2(c) change by the symbol that enters
and the one that leaves, and a window is flagged if its Shannon entropy reaches the
bound of its class, which about 98 of 100 random windows of that alphabet do. Flagged
windows that touch make one span. A candidate on the allow list (plain words,
identifiers, numbers, paths, well-known digests, example keys) adds none; it is judged
alone, so a key joined to something allowed by a character outside its class is still
found. Base spans stay in any case. Spans of several classes may overlap.

All is built-in expressions, and work grows with the text: positions and the joining
of spans come from running values in short blocks, candidates are walked in chunks that
share a window less one character. Sums of c*log2(c) are scaled integers, so the result
doesn't depend on the order of additions.

Spans are code points, end exclusive. Defined cases: a null or empty text has no
spans; repeated rows are scanned each; other columns pass through ``redact`` and
are not read by ``scan``.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(_either_case(x) for x in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
#: Base kinds in their order, with a pattern and the shortest that counts (of group 2 for assign).
ASSIGN = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
SHORTEST = {"assign": 12, "access": 18, "hex": 16}
#: A run of digits of at least the length that counts: shorter runs would be dropped.
HEX = f"[0-9a-f]{{{SHORTEST['hex']},}}"

WINDOW = 20
#: Of each class: pattern of a candidate, what it must contain (all of these), alphabet and bits a character in a window
#: from which it is flagged. A candidate of a smaller class is left to that class. Words before a separator don't
#: belong to a base-64 run: its first two alternatives take them, and no such word passes ``CLASSES[...][1]``.
CLASSES = {
    "entropy_hex": (f"[0-9A-Fa-f]{{{WINDOW},}}", (), "0123456789abcdef", 2.93),
    "entropy_base36": (f"[a-z0-9]{{{WINDOW},}}|[A-Z0-9]{{{WINDOW},}}", ("[g-zG-Z]",), "abcdefghijklmnopqrstuvwxyz0123456789", 3.43),
    "entropy_base62": (f"[A-Za-z0-9]{{{WINDOW},}}", ("[g-zG-Z]", "[a-z]", "[A-Z]"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3.67),
    "entropy_base64": (f"[A-Za-z]?[a-z]{{3,}}[+/_-]+|[A-Z]{{4,}}[+/_-]+|[A-Za-z0-9+/_-]{{{WINDOW},}}", ("[+/_-]", "[a-z]", "[A-Z]"),
                       "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 3.67),
}
#: Classes whose letters count alike in either case; the other base-64 alphabet's characters stand for these.
LOWERED = ("entropy_hex", "entropy_base36")
TRANSLATED = ("-_", "+/")
#: Candidates that match are never secrets by entropy.
ALLOWED = ("EXAMPLE|example", "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
           # fixed values: digests of the empty input and of the empty tree, first part of a published example key
           "^(?:da39a3ee5e6b4b0d3255bfef95601890afd80709|d41d8cd98f00b204e9800998ecf8427e|4b825dc642cb6eb9a060e54bf8d69288fbee4904"
           "|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)$", "wJalrXUtnFEMI")
#: A candidate without any of these is made of plain words, capitalised words, abbreviations and numbers.
NOT_PLAIN = "[0-9][A-Za-z]|[A-Z][A-Z][a-z]|[a-z][A-Z](?:[^a-z]|$)"
KINDS = ("assign", "access", "hex", *CLASSES)

#: Elements of an array that a fold runs over before what it gathers starts anew.
FOLD = 64
#: Windows of one chunk of a candidate.
CHUNK = 256
#: Code points of a piece of text from which cuts are made.
PIECE = 2048
#: Bits of a count, and counts in one number.
COUNT_BITS, PACKED = 5, 12

SCALE = 1 << 20
#: SCALE * c * log2(c) for the counts a window can hold.
WEIGHTS = [0] + [round(SCALE * c * math.log2(c)) for c in range(1, WINDOW + 1)]


def most_weight(bits: float) -> int:
    """A window is flagged while its sum of weights is at most this."""
    return math.floor(SCALE * WINDOW * (math.log2(WINDOW) - bits))


def _matches(df: DataFrame, kinds: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add m_<kind> (matches) and p_<kind> (what lies between them), null where the text has no match."""
    t = F.col("t")
    df = df.select("*", *(F.when(guard & F.rlike(t, F.lit(p)), F.regexp_extract_all(t, F.lit(p), F.lit(0))).alias(f"m_{k}") for k, (p, guard) in kinds.items()))
    return df.select("*", *(F.when(F.col(f"m_{k}").isNotNull(), F.split(t, p, -1)).alias(f"p_{k}") for k, (p, _) in kinds.items()))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join, kind: str = "int", levels: int = 2) -> Column:
    """Array of the running values (``join`` of two numbers) of an array, in steps that grow with it.

    Blocks of ``FOLD`` elements are folded each, then the blocks' last values in the
    same way: a fold appends to a short array only.
    """
    def fold(a: Column, first: Column, count: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        return F.when(count > 0, F.aggregate(F.sequence(first, first + count - 1), none, lambda out, i: F.concat(out, F.array(
            F.when(F.size(out) > 0, join(F.element_at(out, -1), F.get(a, i))).otherwise(F.get(a, i)))))).otherwise(none)

    if levels == 0:
        return fold(values, F.lit(0), F.size(values))

    def blocks(a: Column) -> Column:
        count = F.ceil(F.size(a) / FOLD).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: fold(a, b * FOLD, F.least(F.lit(FOLD), F.size(a) - b * FOLD)))).otherwise(
            F.array().cast(f"array<array<{kind}>>"))

    def joined(within: Column) -> Column:
        return _let(_running(F.transform(within, lambda x: F.element_at(x, -1)), join, kind, levels - 1), lambda before: F.flatten(F.transform(
            within, lambda x, b: F.when(b > 0, F.transform(x, lambda y: join(F.get(before, b - 1), y))).otherwise(x))))

    return _let(values, lambda a: _let(blocks(a), joined))


def _located(kind: str) -> Column:
    """Structs (s, e, t) of the matches of a kind, with code-point offsets."""
    found, between = f"m_{kind}", f"p_{kind}"
    empty = F.array().cast("array<struct<s:int,e:int,t:string>>")

    def placed(matches: Column, gaps: Column) -> Column:
        steps = F.transform(matches, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))
        return _let(_running(steps, lambda a, b: a + b), lambda ends: F.transform(
            matches, lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("s"), F.get(ends, i).alias("e"), x.alias("t"))))

    # bound once: an optimiser that merges projections would otherwise split the text again for every match
    return F.when(F.col(found).isNull(), empty).otherwise(_let(F.col(found), lambda m: _let(F.col(between), lambda p: placed(m, p))))


def _touching(spans: Column, apart) -> Column:
    """Spans (s, e) in order of both, joined into one wherever ``apart`` (start, end before) does not hold."""
    def joined(x: Column) -> Column:
        starts = F.filter(x, lambda y, i: (i == 0) | apart(y["s"], F.get(x, i - 1)["e"]))
        ends = F.filter(x, lambda y, i: (i == F.size(x) - 1) | apart(F.get(x, i + 1)["s"], y["e"]))
        return F.zip_with(starts, ends, lambda a, b: F.struct(a["s"].alias("s"), b["e"].alias("e")))

    return _let(spans, joined)


def _high_entropy(codes: Column, alphabet: str, bits: float) -> Column:
    """Spans (offsets within the candidate) of the flagged windows; ``codes`` are the candidate's characters."""
    weight = F.array(*map(F.lit, WEIGHTS))
    symbol = F.array(*(F.lit(max(alphabet.find(chr(i)), 0)) for i in range(128)))
    words = -(-len(alphabet) // PACKED)
    shift = lambda c: (F.pmod(c, F.lit(PACKED)) * COUNT_BITS).cast("int")
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))
    word = lambda c: F.floor(c / PACKED).cast("int")
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), shift(c)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")
    at = lambda i: F.get(symbol, F.ascii(F.get(codes, i)))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def chunk(first: Column) -> Column:
        """Spans of the windows that start at first to first + CHUNK - 1."""
        def slide(a: Column, i: Column, new: Column, old: Column) -> Column:
            # the one that leaves goes first, so no count exceeds the window
            left = F.when(old >= 0, count(a["counts"], old)).otherwise(F.lit(0))
            less = F.when(old >= 0, F.get(weight, left - 1) - F.get(weight, left)).otherwise(F.lit(0))
            had = count(a["counts"], new) - F.when(new == old, 1).otherwise(0)
            total = a["sum"] + less + F.get(weight, had + 1) - F.get(weight, had)
            counts = F.transform(a["counts"], lambda c, k: c + F.when(k == word(new), one(new)).otherwise(F.lit(0).cast("long")) - F.when(
                (old >= 0) & (k == word(old)), one(old)).otherwise(F.lit(0).cast("long")))
            hit = (i - first >= WINDOW - 1) & (total <= most_weight(bits))
            joins = hit & (i - (WINDOW - 1) <= a["e"])
            return F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(hit & ~joins, i - (WINDOW - 1)).otherwise(a["s"]).alias("s"), F.when(hit, i + 1).otherwise(a["e"]).alias("e"),
                F.when(hit & ~joins & (a["e"] > 0), F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"]).alias("out"))

        def step(a: Column, i: Column) -> Column:
            return slide(a, i, at(i), F.when(i - first >= WINDOW, at(i - WINDOW)).otherwise(F.lit(-1)))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0).alias("sum"), F.lit(0).alias("s"), F.lit(-1).alias("e"), none.alias("out"))
        return F.aggregate(F.sequence(first, F.least(first + (CHUNK + WINDOW - 2), F.size(codes) - 1)), start, step,
                           lambda a: F.when(a["e"] > 0, F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e"))))).otherwise(a["out"]))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(codes) - WINDOW) / CHUNK).cast("int")), lambda c: chunk(c * CHUNK))
    return _touching(F.flatten(chunks), lambda s, e: s > e)


def with_spans(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns as c_0, c_1, ..., the text as t and spans: array of (s, k, e), k the number of the kind in KINDS, in order."""
    df = docs.select(*(F.col(c).alias(f"c_{i}") for i, c in enumerate(carry)), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    always = F.lit(True)
    # a text without a run of base-64 characters has no candidate of any class
    df = df.withColumn("long", F.rlike("t", F.lit(f"[A-Za-z0-9+/_-]{{{WINDOW}}}")))
    df = _matches(df, {"assign": (ASSIGN, always), "access": (ACCESS, F.contains(F.col("t"), F.lit("AKIA"))),
                       "hex": (HEX, always), **{k: (c[0], F.col("long")) for k, c in CLASSES.items()}})
    df = df.select("*", F.when(F.col("m_assign").isNotNull(), F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))).alias("values"), *(_located(k).alias(f"l_{k}") for k in KINDS))
    number = {k: i for i, k in enumerate(KINDS)}

    def base(name: str) -> Column:
        kept = (_let(F.col("values"), lambda v: F.filter("l_assign", lambda x, i: F.length(F.get(v, i)) >= SHORTEST["assign"])) if name == "assign"
                else F.filter(f"l_{name}", lambda x: F.length(x["t"]) >= SHORTEST[name]))
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(number[name]).alias("k"), x["e"].alias("e")))

    def added(kind: str) -> Column:
        _, must, alphabet, bits = CLASSES[kind]

        def judged(x: Column) -> Column:
            fits = reduce(and_, (F.rlike(x["t"], F.lit(p)) for p in (*must, NOT_PLAIN)), F.length(x["t"]) >= WINDOW)
            return fits & ~reduce(or_, (F.rlike(x["t"], F.lit(p)) for p in ALLOWED))

        same = lambda x: F.lower(x) if kind in LOWERED else F.translate(x, *TRANSLATED)
        spans = lambda x: _let(F.split(same(x["t"]), ""), lambda codes: _high_entropy(codes, alphabet, bits))
        return F.flatten(F.transform(F.filter(f"l_{kind}", judged), lambda x: F.transform(
            spans(x), lambda y: F.struct((x["s"] + y["s"]).alias("s"), F.lit(number[kind]).alias("k"), (x["s"] + y["e"]).alias("e")))))

    return df.select(*(f"c_{i}" for i in range(len(carry))), "t",
                     F.array_sort(F.concat(*map(base, SHORTEST), *map(added, CLASSES))).alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, and all spans."""
    of = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return with_spans(docs, ["doc_id"]).select(
        F.col("c_0").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_written(F.filter("spans", lambda x: x["k"] < 3)), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span (overlapping ones as one) replaced by ``mark``; ``n_chars`` follows if there is one."""
    columns = docs.columns
    inner = with_spans(docs, columns)
    found = F.size("spans") > 0
    # spans are in order of their starts: ends become running maxima, then what overlaps is one
    reach = _running(F.transform("spans", lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    merged = _let(reach, lambda ends: _touching(F.transform("spans", lambda x, i: F.struct(x["s"].alias("s"), F.get(ends, i).alias("e"))), lambda s, e: s >= e))
    inner = inner.select("*", F.when(found, merged).alias("gone"), F.when(found, F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("pieces"))

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """The text from a to b."""
        piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
        p, q = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        x, y = F.pmod(a, F.lit(PIECE)), F.pmod(b, F.lit(PIECE))
        middle = F.array_join(F.slice(pieces, p + 2, F.greatest(q - p - 1, F.lit(0))), "")
        return F.when(p == q, F.substr(piece(p), x + 1, b - a)).otherwise(F.concat(F.substr(piece(p), x + 1), middle, F.substr(piece(q), F.lit(1), y)))

    def joined(gone: Column, pieces: Column) -> Column:
        between = F.transform(gone, lambda x, i: cut(pieces, F.coalesce(F.get(gone, i - 1)["e"], F.lit(0)), x["s"]))
        return F.array_join(F.concat(between, F.array(cut(pieces, F.element_at(gone, -1)["e"], F.length("t")))), mark)

    new = _let(F.col("gone"), lambda gone: _let(F.col("pieces"), lambda pieces: joined(gone, pieces)))
    inner = inner.withColumn("new", F.when(found, new))
    out = []
    for i, name in enumerate(columns):
        value = F.col(f"c_{i}")
        if name == "text":
            value = F.coalesce("new", value)
        elif name == "n_chars":
            value = F.coalesce(F.length("new"), value).cast(docs.schema["n_chars"].dataType)
        out.append(value.alias(name))
    return inner.select(*out)
