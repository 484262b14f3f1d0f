"""Personal data: exact patterns, and terms that give the protected values away (information-theoretic sanitisation).

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers, per kind leftmost and non-overlapping;
matches that fail their check are dropped. Positions are code points, end exclusive.

Terms: for every protected value e and every word t of a text that holds it, the corpus says how much t tells about e:
PMI(t; e) = log(P(e | t) / P(e)) against the information IC(e) = -log P(e) of the value itself. The unit of all counts
is the different text (copies count once, words inside values do not count): n texts, n_e with the value, n_t with the
word, n_te with both; P(e) = n_e / n. P(e | t) = (n_te + PRIOR P(e)) / (n_t + PRIOR) is smoothed towards independence, so
a word seen once says less than one seen often with the value, and a value of a single text has terms too. Words that
reveal at least DISCLOSURE of the information are spans of kind `term` in the texts that hold word and value.

Values that stand in the same texts have the same counts and are one class. As n_te <= n_e, a word with
n_t + PRIOR > (n + PRIOR) P(e)^DISCLOSURE cannot disclose, so only rarer words are paired with a class.

Everything is Spark SQL: matches are wrapped in two private-use characters, the text is split there, and running
lengths give the positions. Patterns are possessive, so they neither backtrack over long runs nor recurse. Arrays of k
matches are worked through in about sqrt(k) blocks of as many, so nothing is rebuilt per match: a running sum copies at
most a block, and a cut reads at most a block's piece of the text. Terms of a text are looked up by hash bucket, and
values of a single text, which all words of the text stand with once, are not paired with words at all.

Defined results: NULL texts count as empty (sanitise keeps them NULL); spans of different kinds may overlap; term
spans never overlap pattern spans; equal rows give equal spans; private-use marks in a text match nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stash
from .text import documents

KINDS = ["email", "ip", "card", "phone"]
LETTERS = 4             # least length of a term
PRIOR = 1.0             # texts without a connection that every word counts besides its own
TERM_BUCKETS = 64       # lists that the terms of a text are looked up in
DISCLOSURE = 0.7        # least share of the value's information that the term reveals
OPEN, CLOSE, OTHER = "", "", ""

# a match can begin only at the start of a run of its first class or right after the match before
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
SPAN = "array<struct<start:int,kind:int,end:int>>"      # kind: place in KINDS, 4 for terms


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of the digits (from the right, every second one doubled) is a multiple of ten."""
    d = F.reverse(digits)

    def value(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    n = F.length(_digits(match))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(match))).otherwise(False)
    return (n >= 10) & (n <= 15) if kind == "phone" else F.lit(True)


def _marked(text: Column, pattern: Column) -> Column:
    """[no match, match, no match, ...]: the text cut around every match."""
    marked = F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{OPEN}$1{CLOSE}"))
    return F.split(marked, f"[{OPEN}{CLOSE}]", -1)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once; inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """The array as an array of about sqrt(size) neighbouring pieces."""
    def cut(x: Column) -> Column:
        size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(x))).cast("int"))
        n = F.ceil(F.size(x) / size).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: F.slice(x, b * size + 1, size))
                      ).otherwise(F.slice(F.array(x), 1, 0))

    return _let(items, cut)


def _running(blocks: Column, of_block, join) -> Column:
    """For every block what the blocks before it come to: of_block(block) put together by join, 0 for the first."""
    return F.aggregate(F.transform(blocks, of_block), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))


def _positions(parts: Column, kind: int, valid) -> Column:
    """Spans of the matches among `parts`, every second one, that pass `valid`."""
    def found(block: Column, before: Column, odd: Column) -> Column:
        start = F.struct(before.alias("at"), odd.alias("odd"), F.array().cast(SPAN).alias("spans"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.char_length(part)
            span = F.array(F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
            return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"),
                            F.when(acc["odd"] & valid(part), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(block, start, step, lambda acc: acc["spans"])

    def over(blocks: Column) -> Column:
        chars = _running(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, part: n + F.char_length(part)), lambda x, y: x + y)
        size = F.size(F.get(blocks, F.lit(0)))
        return _let(chars, lambda before: F.flatten(F.transform(
            blocks, lambda b, i: found(b, F.get(before, i), (i * size) % 2 == 1))))

    return _let(_blocks(parts), over)


def pattern_spans(text: Column) -> Column:
    """All pattern spans of a text by start, then kind."""
    clean = F.when(text.rlike(f"[{OPEN}{CLOSE}]"), F.translate(text, OPEN + CLOSE, OTHER * 2)).otherwise(text)
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"),
            "phone": text.rlike(r"\+[0-9]")}
    none = F.array().cast(SPAN)
    found = [F.when(hint[kind], _positions(_marked(clean, F.lit(PATTERNS[kind])), i, lambda m, k=kind: _valid(k, m))).otherwise(none)
             for i, kind in enumerate(KINDS)]
    return F.when(text.contains("@") | text.rlike("[0-9]"), F.array_sort(F.concat(*found))).otherwise(none)


def _pieces(text: Column, spans: Column, piece) -> Column:
    """piece(cut, span, at) of every span in order: cut(start, end) is the text there, at the furthest end before it."""
    def of_block(block: Column, before: Column) -> Column:
        first = F.least(before, F.get(block, F.lit(0))["start"])
        last = F.greatest(before, F.array_max(F.transform(block, lambda s: s["end"])))
        ends = F.aggregate(block, F.array(before), lambda acc, s: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), s["end"]))))
        part = F.struct(first.alias("first"), F.substring(text, first + 1, last - first).alias("text"), ends.alias("ends"), block.alias("spans"))

        def inside(p: Column) -> Column:
            def cut(start: Column, end: Column) -> Column:
                return F.substring(p["text"], start - p["first"] + 1, F.greatest(end - start, F.lit(0)))
            return F.transform(p["spans"], lambda s, i: piece(cut, s, F.get(p["ends"], i)))

        return _let(part, inside)

    def over(blocks: Column) -> Column:
        ends = _running(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])), F.greatest)
        return _let(ends, lambda before: F.flatten(F.transform(blocks, lambda b, i: of_block(b, F.get(before, i)))))

    return _let(_blocks(spans), over)


def _replaced(text: Column, spans: Column, written) -> Column:
    """The text with written(span, at) in place of every span; what spans cover goes, at is the furthest end before."""
    def piece(cut, s: Column, at: Column) -> Column:
        return F.concat(cut(at, s["start"]), written(s, at))

    rest = _let(F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"])), F.lit(0)),
                lambda end: F.substring(text, end + 1, F.greatest(F.char_length(text) - end, F.lit(0))))
    return F.concat(F.array_join(_pieces(text, spans, piece), ""), rest)


def _words(c: Column) -> Column:
    """Different words of a text, lower-cased."""
    long = F.filter(F.split(c, r"[^\p{L}]+"), lambda w: F.char_length(w) >= LETTERS)
    return F.array_distinct(F.transform(long, F.lower))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every code point of a span replaced by OTHER, so positions stay."""
    return _replaced(text, spans, lambda s, at: F.repeat(F.lit(OTHER), F.greatest(s["end"] - F.greatest(at, s["start"]), F.lit(0))))


def disclosing_terms(values: DataFrame, texts: DataFrame) -> DataFrame:
    """text_hash, terms: the words of a text that reveal too much of a value in it, in TERM_BUCKETS lists by hash.

    values(entity, text_hash) and texts(text_hash, words): different rows, texts of all documents."""
    per_class = ["n_e", "_a", "_b"]                     # two hashes of the set of texts
    entities = values.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor("text_hash").alias("_a"),
                                            F.bit_xor(F.xxhash64("text_hash")).alias("_b"))
    held = stash(values.join(entities, "entity").select("text_hash", *per_class).distinct(), "classes")
    n = float(max(texts.count(), 1))
    most = (n + PRIOR) * F.pow(F.col("n_e") / n, F.lit(DISCLOSURE)) * (1 + 1e-9)
    largest = held.agg(F.max(most).alias("most")).first()["most"] or 0.0
    words = (texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
             .where(F.col("n_t") + PRIOR <= largest))
    rare = stash(texts.join(held.select("text_hash").distinct(), "text_hash", "left_semi")
                 .select("text_hash", F.explode("words").alias("term")).join(words, "term"), "rare")

    def tells(n_te: Column, n_e: Column) -> Column:
        given = (n_te + PRIOR * n_e / n) / (F.col("n_t") + PRIOR)
        information = F.log(F.lit(n) / n_e)
        return (information > 0) & (F.log(given * n / n_e) >= DISCLOSURE * information)

    # a value of one text stands with each of its words once: no pairs to count
    alone = (rare.join(held.where("n_e = 1").select("text_hash").distinct(), "text_hash", "left_semi")
             .where(tells(F.lit(1), F.lit(1))).select("text_hash", "term"))
    near = stash(rare.join(held.where("n_e > 1"), "text_hash").where(F.col("n_t") + PRIOR <= most), "near")
    told = (near.groupBy(*per_class, "term", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
            .where(tells(F.col("n_te"), F.col("n_e"))).select(*per_class, "term"))
    both = alone.unionByName(near.join(told, [*per_class, "term"]).select("text_hash", "term")).distinct()
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int")
    lists = (both.groupBy("text_hash", bucket.alias("b")).agg(F.sort_array(F.collect_list("term")).alias("t"))
             .groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct("b", "t"))).alias("m")))
    return lists.select("text_hash", F.transform(F.sequence(F.lit(0), F.lit(TERM_BUCKETS - 1)), lambda b: F.element_at("m", b)).alias("terms"))


def annotate(docs: DataFrame) -> DataFrame:
    """`docs` with `_spans`: pattern and term spans of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spotted = docs.withColumn("_spans", pattern_spans(text)).withColumn("_hash", F.xxhash64(text))
    rest = spotted.where(F.size("_spans") == 0).drop("_hash")
    found = stash(spotted.where(F.size("_spans") > 0), "found")
    masked = _masked(F.translate("text", OPEN + CLOSE, OTHER * 2), F.col("_spans"))
    entities = F.array_distinct(_pieces(F.col("text"), F.col("_spans"), lambda cut, s, at: F.lower(cut(s["start"], s["end"]))))
    values = stash(found.select(F.col("_hash").alias("text_hash"), F.explode(entities).alias("entity")).distinct(), "values")
    words = [found.select("_hash", _words(masked).alias("words")), rest.select(F.xxhash64(text).alias("_hash"), _words(text).alias("words"))]
    texts = stash(words[0].unionByName(words[1]).groupBy(F.col("_hash").alias("text_hash")).agg(F.first("words").alias("words")), "texts")
    terms = disclosing_terms(values, texts).select(F.col("text_hash").alias("_hash"), F.col("terms").alias("_terms"))
    word = F.lit(rf"(?<!\p{{L}})\p{{L}}{{{LETTERS},}}+")
    extra = F.when(F.col("_terms").isNotNull(), _positions(
        _marked(masked, word), len(KINDS), lambda m: F.coalesce(F.array_contains(
            F.get("_terms", F.pmod(F.xxhash64(F.lower(m)), F.lit(TERM_BUCKETS)).cast("int")), F.lower(m)), F.lit(False))))
    full = found.join(terms, "_hash", "left").withColumn(
        "_spans", F.array_sort(F.concat("_spans", F.coalesce(extra, F.array().cast(SPAN)))))
    return full.drop("_hash", "_terms").unionByName(rest)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "term"]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans."""
    base = F.filter("_spans", lambda s: s["kind"] < len(KINDS))
    return annotate(documents(docs, "doc_id", "text")).select(
        "doc_id", *(F.size(F.filter(F.col("_spans.kind"), lambda k: k == F.lit(i))).cast("long").alias(f"n_{kind}")
                    for i, kind in enumerate(KINDS)),
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with every span in the texts replaced by its kind in brackets; n_chars, if there, follows."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "term"]])
    # a span that begins inside an earlier one has no tag of its own
    new = _replaced(F.col("text"), F.col("_spans"), lambda s, at: F.when(s["start"] >= at, F.get(tags, s["kind"])).otherwise(""))
    out = annotate(docs).withColumn("text", F.when(F.size("_spans") > 0, new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
