"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions alone.

Seeds are the matches of four fixed kinds; candidates are other tokens and groups of numbers that look like
identifiers.  Each has several patterns: the two words before it; the word before and the word after; its shape
(letters as a, digits as 0) with either word; and its shape alone.  Patterns and instances form a graph that is
scored in turns: a pattern of words by the mean score of its instances, an instance by how surely some pattern leads
to it; a pattern with a shape by the share of seeds among its instances.  Candidates with a pattern of high
confidence are unseen identifiers, and become spans of kind ``context``; they count like seeds for further patterns
of words, until no new one becomes confident.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut

ROUNDS = 3
#: A pattern needs so many different seeds or accepted instances, and at last this confidence.
LEAST_SEEDS, LEAST_CONFIDENCE = 5, 0.6
#: A longer pattern is named by its MD5 (which has no space, as patterns have), so that rows stay short.
LONGEST = 64
KINDS = ["email", "ip", "card", "phone", "context"]

# The base kinds.  Each begins where no earlier character could belong to the match, or where the
# last match ended (\G); with that and possessive loops a long run of one class is read once, not once for
# each of its characters, and the matches are the leftmost ones as before.
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "instr(text, '@') > 0", "true"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"text rlike '[0-9][.][0-9]'", f"v.s rlike '^(?:{_PART}[.]){{3}}{_PART}$'"),
    "card": (r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++", r"text rlike '(?:[0-9][ -]?){11}[0-9]'", "length(regexp_replace(v.s, '[ -]', '')) between 12 and 19 and luhn_check(regexp_replace(v.s, '[ -]', ''))"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "instr(text, '+') > 0", "length(regexp_replace(v.s, '[^0-9]', '')) between 9 and 15"),
}
#: Candidates: runs of sign, letter and digit, with four digits or an @; and groups of numbers with seven digits.
_CANDIDATES = [
    (r"(?:(?<![A-Za-z0-9_.@+/-])|\G)(?=[A-Za-z_.+/-]*+[0-9@])[A-Za-z0-9_.@+/-]++", "text rlike '[0-9@]'", "length(regexp_replace(v.s, '[^0-9]', '')) >= 4 or v.s rlike '[a-z0-9]@[a-z0-9]'"),
    (r"(?<![A-Za-z0-9_.@/-])\+?+\(?+[0-9]++(?:[ ().-]{1,2}[0-9]++)++", "text rlike '[0-9][)]? [(]?[0-9]'", "length(regexp_replace(v.s, '[^0-9]', '')) >= 7 and v.s rlike '[ ()]'"),
]
_MATCH = "array<struct<start: bigint, end: bigint, s: string, patterns: array<string>>>"
#: Matches whose positions are added up together.
_SLICE = 256


def _plain(text: str) -> str:
    """SQL: lower-cased, runs of digits as 0 and of white space as one space.  No match begins or ends inside such
    a run, so pieces may be treated one by one (a final sigma is a sigma for that reason)."""
    return f"regexp_replace(regexp_replace(translate(lower({text}), 'ς', 'σ'), '[0-9]+', '0'), '\\\\s+', ' ')"


def _patterns(before: str, after: str) -> str:
    """SQL: the patterns of a match ``v.s`` between plain texts.  Long ones are named by their MD5."""
    two, one, right = f"substring_index(trim({before}), ' ', -2)", f"substring_index(trim({before}), ' ', -1)", f"substring_index(trim({after}), ' ', 1)"
    letters = "regexp_replace(v.s, '[A-Za-z]+', 'a')"
    shape, loose = f"regexp_replace({letters}, '[0-9]', '0')", f"regexp_replace({letters}, '[0-9]+', '0')"
    short = lambda x: f"CASE WHEN length({x}) > {LONGEST} THEN md5({x}) ELSE {x} END"
    return f"""array_compact(array(
        CASE WHEN instr({two}, ' ') > 0 THEN concat('W ', {short(two)}) END,
        CASE WHEN {one} <> '' AND {right} <> '' THEN concat('W ', {short(f"concat({one}, ' _ ', {right})")}) END,
        CASE WHEN {one} <> '' THEN concat('S ', {short(f"concat({one}, ' ', {loose})")}) END,
        CASE WHEN {right} <> '' THEN concat('S ', {short(f"concat({loose}, ' ', {right})")}) END,
        concat('S ', {short(shape)}), concat('S ', {short(loose)})))"""


def _matches(rule: tuple[str, str, str]) -> str:
    """SQL for the matches of a rule in ``text``, with their code points and patterns.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to positions.
    The last words are carried over all of them, matches included, so that none of a list loses its context.
    Matches are added up in slices, as appending to one long array would copy it each time.
    """
    pattern, worth, valid = rule
    quoted = "r'" + pattern + "'"
    return f"""
    CASE WHEN {worth} THEN element_at(transform(array(split(text, {quoted}, -1)), ps ->
      element_at(transform(array(zip_with(zip_with(ps, regexp_extract_all(text, {quoted}, 0), (p, s) -> struct(p AS p, s AS s)), slice(ps, 2, 2147483647), (x, q) -> struct(x.p AS p, x.s AS s, q AS q))), z ->
      aggregate(sequence(0, size(z) div {_SLICE}), struct(0L AS at, '' AS words, cast(array() AS array<{_MATCH}>) AS found),
        (o, i) -> aggregate(slice(z, i * {_SLICE} + 1, {_SLICE}), struct(o.at AS at, o.words AS words, cast(array() AS {_MATCH}) AS found),
          (a, v) -> CASE WHEN v.s IS NULL THEN a ELSE struct(
            a.at + length(v.p) + length(v.s) AS at,
            substring_index(concat(a.words, {_plain("v.p")}, {_plain("v.s")}), ' ', -3) AS words,
            CASE WHEN {valid} THEN array_append(a.found, struct(a.at + length(v.p) AS start, a.at + length(v.p) + length(v.s) AS end, v.s AS s, {_patterns(f"concat(a.words, {_plain('v.p')})", _plain("v.q"))} AS patterns)) ELSE a.found END AS found) END,
          a -> struct(a.at AS at, a.words AS words, array_append(o.found, a.found) AS found)),
        o -> flatten(o.found))), 1)), 1) ELSE cast(array() AS {_MATCH}) END"""


def trusted_patterns(edges: DataFrame) -> DataFrame:
    """(pattern) of every pattern of edges(pattern, value, seed) that becomes confident.

    Each turn takes the patterns with LEAST_SEEDS instances that are seeds or, for patterns of words, were accepted in
    earlier turns (after a trusted pattern), scores their graph in ROUNDS rounds from these, and ends the search if no
    pattern is new.  Confidences are written before they are joined, so that Spark can split a pattern of very many
    instances.
    """
    words = F.col("pattern").startswith("W ")
    start, trusted = edges.withColumn("score", F.col("seed").cast("double")), None
    while True:
        # Patterns with fewer can't be confident in this turn, so the graph keeps the others alone
        able = start.groupBy("pattern").agg(F.count_if((F.col("score") > 0) & (words | (F.col("seed") > 0))).alias("known")).where(F.col("known") >= LEAST_SEEDS).select("pattern")
        scored = graph = cut(start.join(cut(able, "able"), "pattern", "left_semi"), "graph")
        for _ in range(ROUNDS):
            confident = cut(confidence(scored), "confident")
            sure = graph.join(confident, "pattern")
            instances = sure.groupBy("value").agg(F.max("score").alias("known"), (F.lit(1.0) - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("reached"))
            scored = graph.drop("score").join(instances.select("value", F.greatest("known", "reached").alias("score")), "value")
            scored = cut(scored.select("pattern", "value", "seed", "score"), "scored")
        found = confidence(scored).where(F.col("confidence") >= LEAST_CONFIDENCE).select("pattern")
        if trusted is not None:
            found = found.join(trusted, "pattern", "left_anti")
        found = cut(found, "trusted")
        if found.isEmpty():
            return found if trusted is None else trusted
        trusted = found if trusted is None else cut(trusted.unionByName(found), "trusted")
        accepted = cut(scored.join(trusted, "pattern", "left_semi").groupBy("value").agg(F.max("score").alias("accepted")), "accepted")
        start = edges.join(accepted, "value", "left").select("pattern", "value", "seed", F.greatest(F.col("seed").cast("double"), F.coalesce("accepted", F.lit(0.0))).alias("score"))


def confidence(scored: DataFrame) -> DataFrame:
    """(pattern, confidence): the mean score of its instances; of a pattern with a shape, their share of seeds."""
    return scored.groupBy("pattern").agg(F.avg(F.when(F.col("pattern").startswith("W "), F.col("score")).otherwise(F.col("seed"))).alias("confidence"))


def personal_spans(docs: DataFrame, seeds: str = "true") -> DataFrame:
    """(doc_id, spans) of every row of docs(doc_id, text): spans is an array of (start, rank, end, kind), in code
    points with the end exclusive, by start and then by kind as listed.

    Null and empty texts have no spans.  Repeated rows and null doc_ids are kept as given; other columns are
    ignored; no rows give no rows.  A text's seeds count once for each pattern, value and corpus.
    ``seeds``: SQL of a match's text ``s`` that tells which base matches are known; the others are hidden, to measure
    how many of them the patterns find again.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tagged = [f"transform({_matches(rule)}, m -> struct(m.start AS start, {rank} AS rank, m.end AS end, '{kind}' AS kind, m.s AS s, m.patterns AS patterns))" for rank, (kind, rule) in enumerate(_BASE.items())]
    found = texts.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.expr(f"concat({', '.join(tagged)})").alias("base"), F.expr(f"concat({', '.join(map(_matches, _CANDIDATES))})").alias("tokens"))
    if seeds != "true":
        found = found.withColumn("base", F.expr(f"filter(base, b -> exists(array(b.s), s -> {seeds}))"))
    found = found.withColumn("tokens", F.expr("filter(tokens, t -> NOT exists(base, b -> b.start < t.end AND t.start < b.end))"))
    found = cut(found, "matches")

    known = found.select(F.explode("base").alias("b")).select(F.explode("b.patterns").alias("pattern"), F.col("b.s").alias("value"), F.lit(1).alias("seed"))
    places = found.select("rid", F.explode("tokens").alias("t")).select("rid", "t.start", "t.end", F.explode("t.patterns").alias("pattern"), F.col("t.s").alias("value"))
    edges = known.unionByName(places.select("pattern", "value", F.lit(0).alias("seed"))).groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    trusted = trusted_patterns(cut(edges, "edges"))
    unseen = places.join(trusted, "pattern", "left_semi").groupBy("rid").agg(F.collect_set(F.struct("start", F.lit(len(_BASE)).alias("rank"), "end", F.lit("context").alias("kind"))).alias("more"))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["rank"].alias("rank"), b["end"].alias("end"), b["kind"].alias("kind")))
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    return found.select("rid", "doc_id", plain.alias("base")).join(unseen, "rid", "left").select("doc_id", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def listed(spans) -> F.Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs(doc_id, text)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(_BASE))
    return personal_spans(docs).select("doc_id", *(count(k) for k in _BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
