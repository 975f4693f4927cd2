"""Operator 10, personal data by bootstrapped contextual extraction (DataFrame functions only).

Four plain patterns find seed entities: email and network addresses, card and phone numbers.  Every seed, and
every other identifier-shaped slot filler (numbers in groups, codes with digits, handles with an at sign,
dotted numbers), stands in five lexical patterns: one and two words to its left, one and two to its right, and
the words on both sides.  Fillers have the form of a kind of seed (``FORMS``); patterns are kept per form.
Patterns and instances make a bipartite graph over the whole corpus, scored in turns: a pattern's confidence is
the mean score of its distinct instances (with one doubtful instance added); an unseen instance's score is the
mean confidence of its attested patterns (those with ``min_seeds`` distinct instances of any score), seeds
staying at 1.  It counts at its best place: the mean is taken over the patterns of one context, and the largest
mean is the score.  From the second turn on, instances found so far support patterns as seeds do, so patterns
that no seed stands in are induced too.  A filler is found where one of its patterns is confident and supported
and the mean over its attested patterns there reaches ``agreement``.

Defined results: null text counts as empty and yields no span; spans are code points, end exclusive; a filler
that overlaps a seed is no instance; repeated rows are scanned one by one, but an instance counts once per
pattern however often it is repeated; equal spans sort by kind; an empty table gives an empty result; only
doc_id and text are read.  Long texts take time in proportion to their length.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm.common import documents, saved, small

KINDS = ["email", "ip", "card", "phone", "found"]
BASE = KINDS[:4]
# Equivalent forms of the plain patterns that start only where a run starts (or where the match before ended),
# so that a long run without a match is read once; quantifiers that need not give back are possessive.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Slot fillers: handles, codes of letters and digits, dotted numbers, numbers in groups of two or more digits.
HANDLE = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)*+"
CODE = r"[A-Za-z]{1,8}[_-]?[0-9][A-Za-z0-9]*+(?:[_-][A-Za-z0-9]++)*+"
GROUPS = r"\+?\(?[0-9]{2,}+(?:[\x20().-]{1,2}[0-9]{2,}+)*+[A-Za-z0-9_-]*+"
DOTTED = r"[0-9]++(?:\.[0-9]++){2,}+"
TOKEN = rf"(?<![A-Za-z0-9_@.%+-])(?:{HANDLE}|{CODE}|{DOTTED}|{GROUPS})"
FORMS = {"email": "handle", "ip": "dotted", "card": "number", "phone": "number"}
SIDES = ("left", "left two", "right", "right two", "both")
SPAN = "array<struct<start:int,end:int,kind:string,word:string>>"
CONTEXT_CHARS = 64
CHUNK = 1024                # characters of text in which a context is looked up
BLOCK = 256                 # matches whose positions are added up together
SALT = 16                   # shares of a frequent pattern's instances


def let(value, body):
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _spans(kind: str, pattern: str, keep=None, guard=None):
    """Spans of the leftmost non-overlapping matches: what each match and the text before it take up.  Positions
    are added up in blocks, then over the blocks, so that no long array is appended to match by match."""
    text = F.col("text")
    # Anchored where the match before ended: without \G, every position after the last match would start over.
    with_gap = F.lit(r"(?s)\G(.*?)(" + pattern + ")")
    gaps = F.transform(F.regexp_extract_all(text, with_gap, F.lit(1)), lambda s: F.length(s))
    words = F.regexp_extract_all(text, with_gap, F.lit(2))
    empty = F.array().cast(SPAN)

    def block(pairs):
        return F.aggregate(
            pairs, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
            lambda acc, p: F.struct(
                (acc["at"] + p["gap"] + F.length(p["word"])).alias("at"),
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + p["gap"]).alias("start"), (acc["at"] + p["gap"] + F.length(p["word"])).alias("end"),
                    F.lit(kind).alias("kind"), p["word"].alias("word")))).alias("spans")))

    def blocks(pairs):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(BLOCK)),
                           lambda first: block(F.slice(pairs, first, F.lit(BLOCK))))

    def moved(parts):
        begins = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
        return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), lambda p, at: F.transform(
            p["spans"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"),
                                           s["kind"].alias("kind"), s["word"].alias("word")))))

    run = let(F.arrays_zip(gaps.alias("gap"), words.alias("word")), lambda pairs: let(blocks(pairs), moved))
    found = F.filter(run, lambda s: keep(s["word"])) if keep else run
    there = text.rlike(pattern) if guard is None else (guard & text.rlike(pattern))
    return F.when(there, found).otherwise(empty)


def _digits(word):
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(word):
    """14 to 19 digits whose weighted sum is a multiple of ten."""
    d = F.reverse(_digits(word))
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(
            (F.substr(d, i, F.lit(1)).cast("int") * 2).cast("int") - F.when(F.substr(d, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)))
    return F.length(d).between(14, 19) & (total % 10 == 0)


def _ip_parts(word):
    """All parts at most 255, whatever zeros they start with."""
    return F.forall(F.split(F.regexp_replace(word, r"(?<![0-9])0+(?=[0-9])", ""), r"\."),
                    lambda p: (F.length(p) <= 3) & (F.substr(p, F.lit(1), F.lit(3)).cast("int") <= 255))


def _phone_digits(word):
    return F.length(_digits(word)).between(10, 15)


def seed_spans():
    digits = F.col("text").rlike("[0-9]")
    return {"email": _spans("email", EMAIL, guard=F.contains("text", F.lit("@"))),
            "ip": _spans("ip", IP, _ip_parts, guard=digits), "card": _spans("card", CARD, luhn, guard=digits),
            "phone": _spans("phone", PHONE, _phone_digits, guard=F.contains("text", F.lit("+")))}


def _filler(word):
    """A handle, or at least four digits."""
    return F.contains(word, F.lit("@")) | (F.length(_digits(word)) >= 4)


def form(word):
    """Form of a slot filler; codes count among the numbers."""
    return (F.when(F.contains(word, F.lit("@")), "handle").when(word.rlike(r"^[0-9]+(\.[0-9]+){2,}$"), "dotted")
            .otherwise("number"))


def overlaps(spans, t):
    """Whether a span of one kind (in order, apart from each other) overlaps ``t``: the last one that starts before
    the end of ``t``, found by halving."""
    bits = F.sequence(F.floor(F.log2(F.size(spans).cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def step(at, bit):
        to = at + F.pow(F.lit(2), bit).cast("int")
        return F.when(F.get(spans, to - 1)["start"] < t["end"], to).otherwise(at)
    last = F.aggregate(bits, F.lit(0), step)
    return F.when(F.size(spans) == 0, False).otherwise(
        F.coalesce(let(last, lambda n: F.when(n > 0, F.get(spans, n - 1)["end"] > t["start"])), F.lit(False)))


def _around(position, left: bool):
    """Up to CONTEXT_CHARS characters before or after a position, folded: lower case, digits as 0."""
    k = F.floor(position / CHUNK).cast("int")
    at = position - F.greatest(k * CHUNK - CONTEXT_CHARS, F.lit(0))     # position in its chunk
    chunk = F.get("chunks", k)
    cut = (F.substr(chunk, F.greatest(at - CONTEXT_CHARS + 1, F.lit(1)), F.least(at, F.lit(CONTEXT_CHARS))) if left
           else F.substr(chunk, at + 1, F.lit(CONTEXT_CHARS)))
    return F.regexp_replace(F.lower(cut), "[0-9]", "0")


def patterns_at(before, after):
    """The lexical patterns of a slot, each with its side; sides without enough words have none."""
    words = [F.regexp_extract(before, r"(\S+)\s*$", 1), F.regexp_extract(before, r"(\S+\s+\S+)\s*$", 1),
             F.regexp_extract(after, r"^\s*(\S+)", 1), F.regexp_extract(after, r"^\s*(\S+\s+\S+)", 1)]
    both = F.when((words[0] != "") & (words[2] != ""), F.concat_ws(" _ ", words[0], words[2])).otherwise("")
    named = [F.when(w != "", F.concat_ws(": ", F.lit(side), F.regexp_replace(w, r"\s+", " ")))
             for side, w in zip(SIDES, [*words, both])]
    return F.array_compact(F.array(*named))


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document: row, doc_id, base and tokens (spans with their patterns and form)."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"),
                               s["end"], s["kind"], s["word"])
    form_of = F.create_map(*[F.lit(x) for pair in FORMS.items() for x in pair])

    def with_context(seed: bool):
        return lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["word"].alias("word"),
            (form_of[s["kind"]] if seed else form(s["word"])).alias("form"),
            patterns_at(_around(s["start"], True), _around(s["end"], False)).alias("patterns"))
    seeds = seed_spans()
    spans = plain.select("*", *[c.alias(f"seeds_{k}") for k, c in seeds.items()],
                         _spans("found", TOKEN, _filler, guard=F.col("text").rlike("[0-9@]")).alias("fillers"))
    # Kind by kind: within a kind, spans lie in order and apart.
    free = F.filter("fillers", lambda t: ~functools.reduce(lambda x, y: x | y, [overlaps(F.col(f"seeds_{k}"), t) for k in BASE]))
    base = F.array_sort(F.transform(F.concat(*[F.col(f"seeds_{k}") for k in BASE]), order))
    chunks = F.when((F.size("base") > 0) | (F.size("tokens") > 0), F.transform(
        F.sequence(F.lit(0), F.floor(F.length("text") / CHUNK).cast("int")),
        lambda k: F.substr(F.col("text"), F.greatest(k * CHUNK - CONTEXT_CHARS, F.lit(0)) + 1, F.lit(CHUNK + 2 * CONTEXT_CHARS))))
    return (spans.select("doc_id", "text", base.alias("base"), free.alias("tokens")).withColumn("chunks", chunks)
            .select(F.monotonically_increasing_id().alias("row"), "doc_id",
                    F.transform("base", with_context(True)).alias("base"),
                    F.transform("tokens", with_context(False)).alias("tokens")))


def meet(rows: DataFrame, values: DataFrame, keys: tuple[str, str] = ("pattern", "form"), by: str = "word") -> DataFrame:
    """Rows with the values of their key.  Values go to the rows where they are few (counted); otherwise both are
    dealt by key and a share (by the column ``by``), so that a frequent key's rows are divided."""
    few = small(values)
    if few is not values:
        return rows.join(few, list(keys))
    shares = values.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return (rows.withColumn("share", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
            .join(shares, [*keys, "share"]).drop("share"))


def attested_patterns(scan: DataFrame, rounds: int = 3, min_seeds: int = 3, confidence: float = 0.7) -> DataFrame:
    """Patterns (pattern, form) with ``min_seeds`` distinct instances or more, scored over the whole corpus: their
    confidence and their support (distinct instances that score ``confidence`` or more, seeds among them)."""
    def contexts(spans, seed):
        return scan.select(F.explode(spans).alias("s")).select("s.patterns", "s.form", "s.word", F.lit(seed).alias("seed"))
    places = (contexts("base", 1.0).unionByName(contexts("tokens", 0.0))
              .groupBy("patterns", "form", "word").agg(F.max("seed").alias("seed")))
    places = saved(places.select(F.explode("patterns").alias("pattern"), F.xxhash64("patterns").alias("context"),
                                 "form", "word", "seed"), "places")
    # Most patterns stand once or twice: only attested ones take part from here on.
    often = saved(places.groupBy("pattern", "form", "word").agg(F.max("seed")).groupBy("pattern", "form").count()
                  .where(F.col("count") >= min_seeds).drop("count"), "often")
    places = saved(meet(places, often), "attested")
    edges = saved(places.groupBy("pattern", "form", "word").agg(F.max("seed").alias("seed")), "edges")
    scored = edges.withColumn("score", F.col("seed"))
    for r in range(rounds):
        patterns = saved(scored.groupBy("pattern", "form").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("confidence"),
            F.count_if(F.col("score") >= confidence).alias("support")), "patterns")
        if r + 1 < rounds:
            words = (meet(places, patterns.select("pattern", "form", "confidence"))
                     .groupBy("form", "word", "context").agg(F.max("seed").alias("seed"), F.avg("confidence").alias("mean"))
                     .groupBy("form", "word").agg(F.greatest(F.max("seed"), F.max("mean")).alias("score")))
            scored = meet(edges, saved(words, "words"), ("form", "word"), "pattern")
    return patterns


def confident_patterns(scan: DataFrame, rounds: int = 3, min_seeds: int = 3, confidence: float = 0.7) -> DataFrame:
    """Attested patterns that mark unseen instances."""
    return (attested_patterns(scan, rounds, min_seeds, confidence)
            .where((F.col("support") >= min_seeds) & (F.col("confidence") >= confidence)))


def find_personal_data(docs: DataFrame, rounds: int = 3, min_seeds: int = 3, confidence: float = 0.7,
                       agreement: float = 0.5) -> DataFrame:
    """Columns doc_id, base and spans: arrays of (start, place, end, kind, word) by start, then kind."""
    scan = saved(scanned(docs), "scan")
    patterns = attested_patterns(scan, rounds, min_seeds, confidence)
    slots = (scan.select("row", F.explode("tokens").alias("t"))
             .select("row", F.col("t").dropFields("patterns", "form").alias("t"), F.explode("t.patterns").alias("pattern"),
                     F.col("t.form").alias("form"), F.col("t.word").alias("word")))
    trusted = (F.col("support") >= min_seeds) & (F.col("confidence") >= confidence)
    found = (meet(slots, patterns).groupBy("row", "t")
             .agg(F.avg("confidence").alias("mean"), F.max(trusted).alias("trusted"))
             .where(F.col("trusted") & (F.col("mean") >= agreement))
             .groupBy("row").agg(F.collect_list("t").alias("found")))
    shape = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"),
                               s["end"].alias("end"), s["kind"].alias("kind"), s["word"].alias("word"))
    base = F.transform("base", shape)
    extra = F.transform(F.coalesce("found", F.array().cast(SPAN)), shape)
    return scan.join(found, "row", "left").select("doc_id", base.alias("base"), F.array_sort(F.concat(base, extra)).alias("spans"))


def joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir, "doc_id", "text"))
    kinds = F.transform("spans", lambda s: s["kind"])

    def count(k):
        return F.size(F.filter(kinds, lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS],
                        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


Q = {"op10_pii_bootstrap": op10_pii_bootstrap}
SQL: dict[str, str] = {}
