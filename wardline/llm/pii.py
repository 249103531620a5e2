"""Personal data: four patterns, and bootstrapped contexts that find identifiers the patterns do not know.

DataFrame functions only. The patterns give the seeds. The words to the left of a seed are a lexical
pattern; patterns and the values that follow them make a graph on which Spark scores both in turns.
Values in a pattern that mostly precedes known data are reported as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.arrays import computed_once
from wardline.llm.common import Scratch

KINDS = ("email", "ip", "card", "phone", "context")  # in the order in which they are listed

# The fixed patterns, written so that no text makes them slow or deep: a match can only begin where a run
# of its first characters begins or the last match ended, and loops never give back what they took.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)(?:[^\s0-9]*+[0-9]){4}\S*+",  # words with four digits or more: what contexts may find
}
NEEDS = {"email": "@", "phone": "+"}  # a character without which the pattern cannot match

CONTEXT = r"((?:\p{L}+[^\p{L}\n]{1,3})?\p{L}+)[^\p{L}\p{N}\n]{0,4}$"  # up to two words before a value
CONTEXT_CHARS = 60    # before a value in which its context is looked for; of a word that begins before them, the end

MIN_SEEDS = 3         # different known values a context needs
MIN_CONFIDENCE = 0.6  # score from which a context finds new values
ROUNDS = 3            # turns of scoring
GENERATIONS = 4       # times the values found may induce contexts of their own


def _staged(df: DataFrame, columns: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    return computed_once(df, columns).drop(*drop)


def pattern_spans(rows: DataFrame) -> DataFrame:
    """The rows (row, id, text) with an array per pattern of (start, end, value, left) instead of the text.

    Matching gives the values, splitting by the same pattern the texts between them; running sums of both
    lengths are the places, in code points. The sums are taken in blocks, so that a text with very many
    matches costs little more than their number. No pattern matches across a line end.
    """
    digits = F.col("text").rlike("[0-9]")
    guards = {k: F.contains("text", F.lit(NEEDS[k])) if k in NEEDS else digits for k in PATTERNS}
    none = F.array().cast("array<string>")
    rows = _staged(rows, {f"m_{k}": F.when(guards[k], F.regexp_extract_all("text", F.lit(p), 0)).otherwise(none)
                          for k, p in PATTERNS.items()})
    rows = _staged(rows, {f"g_{k}": F.when(F.size(f"m_{k}") > 0, F.split("text", p)).otherwise(none)
                          for k, p in PATTERNS.items()}, ("text",))
    lefts = {f"l_{k}": F.transform(F.slice(f"g_{k}", F.lit(1), F.size(f"m_{k}")), lambda g: F.lower(
        F.regexp_extract(F.right(g, F.lit(CONTEXT_CHARS)), CONTEXT, 1))) for k in PATTERNS}
    steps = {f"s_{k}": F.expr(
        f"transform(m_{k}, (x, i) -> length(g_{k}[i]) + if(i = 0, 0, length(m_{k}[i - 1])))") for k in PATTERNS}
    rows = _staged(rows, lefts | steps, tuple(f"g_{k}" for k in PATTERNS))
    rows = _staged(rows, {f"b_{k}": F.expr(
        f"if(size(s_{k}) = 0, cast(array() as array<array<int>>), "
        f"transform(sequence(0, (size(s_{k}) - 1) div 64), b -> slice(s_{k}, b * 64 + 1, 64)))") for k in PATTERNS})
    rows = _staged(rows, {f"t_{k}": F.expr(
        f"transform(b_{k}, k -> aggregate(k, 0, (a, x) -> a + x))") for k in PATTERNS})
    rows = _staged(rows, {f"o_{k}": F.expr(
        f"transform(t_{k}, (t, b) -> aggregate(slice(t_{k}, 1, b), 0, (a, x) -> a + x))") for k in PATTERNS})
    rows = _staged(rows, {f"p_{k}": F.expr(
        f"flatten(transform(b_{k}, (k, b) -> transform(k, (x, i) -> "
        f"o_{k}[b] + aggregate(slice(k, 1, i + 1), 0, (a, y) -> a + y))))") for k in PATTERNS})
    spans = [F.expr(f"transform(m_{k}, (x, i) -> named_struct('start', p_{k}[i], 'end', p_{k}[i] + length(x), "
                    f"'value', x, 'left', l_{k}[i]))").alias(k) for k in PATTERNS]
    return rows.select("row", "id", *spans)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.ltrim(part, F.lit("0")).rlike(
            "^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = F.regexp_replace(value, "[ -]", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _valid_spans(number: int, kind: str) -> Column:
    return F.transform(F.filter(kind, lambda s: _valid(kind, s["value"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
        s["left"].alias("left")))


def base_and_tokens(found: DataFrame) -> DataFrame:
    """(row, id, base, tokens): valid matches as (start, kind, end, value, left), and trimmed digit words."""
    base = [_valid_spans(n, kind) for n, kind in enumerate(KINDS[:4])]
    trimmed = F.transform("token", lambda s: F.struct(
        (s["start"] + F.length(F.regexp_extract(s["value"], "^[^A-Za-z0-9]*+", 0))).alias("start"), F.lit(4).alias("kind"),
        (s["end"] - F.length(F.regexp_extract(s["value"], "(?<![^A-Za-z0-9])[^A-Za-z0-9]*+$", 0))).alias("end"),
        F.btrim(s["value"], F.lit("".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))).alias("value"),
        s["left"].alias("left")))
    return found.select("row", "id", F.array_sort(F.concat(*base)).alias("base"),
                        F.filter(trimmed, lambda s: s["left"] != "").alias("tokens"))


def context_edges(rows: DataFrame) -> DataFrame:
    """(left, value, seed): a context and a value that follows it anywhere; ``seed`` is 1 for values of patterns."""
    seen = (rows.select(F.explode("base").alias("s"), F.lit(1).alias("seed"))
            .union(rows.select(F.explode("tokens").alias("s"), F.lit(0).alias("seed"))))
    return (seen.where("s.left <> ''").groupBy("s.left", F.lower("s.value").alias("value"))
            .agg(F.max("seed").alias("seed")))


def score_contexts(all_edges: DataFrame, scratch: Scratch, min_seeds: int = MIN_SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(left, score) of the contexts that stand before at least ``min_seeds`` different known values.

    Known values score 1. A context scores the mean score of its values with one unknown value added, a value the
    probability that one of its contexts is right. A known value keeps 1. Edges are counted before they are moved,
    and only those of contexts with enough seeds are kept.
    """
    enough = scratch.keep(all_edges.groupBy("left").agg(F.sum("seed").alias("seeds")).where(F.col("seeds") >= min_seeds))
    edges = scratch.keep(all_edges.join(enough.select("left"), "left"))
    values = scratch.keep(edges.groupBy("value").agg(F.max("seed").cast("double").alias("belief")))
    for _ in range(rounds):
        contexts = scratch.keep(edges.join(values, "value").groupBy("left")
                                .agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("score")))
        doubt = F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9))))
        beliefs = edges.join(contexts, "left").groupBy("value").agg(
            F.max("seed").alias("seed"), (1 - F.exp(doubt)).alias("belief"))
        scratch.drop(values)
        values = scratch.keep(beliefs.select("value", F.when(F.col("seed") == 1, 1.0).otherwise(
            F.col("belief")).alias("belief")))
    return contexts


def trusted_contexts(rows: DataFrame, scratch: Scratch, min_seeds: int = MIN_SEEDS,
                     min_confidence: float = MIN_CONFIDENCE, generations: int = GENERATIONS) -> DataFrame:
    """(left) of the contexts that find new values, in generations.

    The values that trusted contexts find are known values of the next generation, so that they induce contexts
    before which no pattern matches. It ends when a generation finds no new value, or after ``generations``.
    """
    edges = scratch.keep(context_edges(rows))
    for generation in range(generations):
        trusted = scratch.keep(score_contexts(edges, scratch, min_seeds).where(F.col("score") >= min_confidence)
                               .select("left"))
        if generation + 1 == generations:
            break
        found = scratch.keep(edges.where("seed = 0").join(trusted, "left", "left_semi").select("value").distinct())
        if not found.limit(1).count():
            break
        marked = edges.join(found.withColumn("found", F.lit(1)), "value", "left")
        edges = scratch.keep(marked.select("left", "value", F.greatest("seed", F.coalesce("found", F.lit(0))).alias("seed")))
    return trusted


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_seeds: int = MIN_SEEDS,
                  min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, base, found): pattern spans, and those with the values contexts add, one row per input row.

    Spans are structs (start, kind, end) in code points, sorted; ``kind`` is a place in KINDS. What contexts
    add never overlaps a pattern span. A null text is empty, a text of any length is read whole, equal rows
    give equal rows, an empty table stays empty, and other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.keep(base_and_tokens(pattern_spans(rows)))
    trusted = trusted_contexts(rows, scratch, min_seeds, min_confidence)
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    new = (rows.select("row", F.explode("tokens").alias("t")).withColumn("left", F.col("t.left"))
           .join(trusted, "left").groupBy("row").agg(F.collect_list(F.struct("t.start", "t.kind", "t.end")).alias("new")))
    apart = F.filter("new", lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"])))
    return (rows.select("row", "id", base.alias("base")).join(scratch.keep(new), "row", "left")
            .select("id", "base", F.when(F.col("new").isNull(), F.col("base"))
                    .otherwise(F.array_sort(F.concat("base", apart))).alias("found")))

