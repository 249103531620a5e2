"""Named entities from a table of known names: persons, organizations, places.

Stands in for a model-based recognizer. The first words of the names are an index: only a word that begins a
name starts a run of words, as long as some name is, and only these runs are looked up in the name table. A model
can be plugged in instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.arrays import computed_once, exploded
from wardline.functions.pii import redaction_tag_column
from wardline.operators.joins import lookup_join

INDEX_WORDS = 20_000  # first words up to which the index is part of the plan; beyond, it is joined


def runs_at(tokens: Column, starts: Column, lengths: Column) -> Column:
    """The different runs of neighbouring words, joined by single spaces, from the given places and of the lengths."""
    def run(start: Column, length: Column) -> Column:
        return F.when(start + length <= F.size(tokens), F.array_join(F.slice(tokens, start + 1, length), " "))

    runs = F.flatten(F.transform(starts, lambda start: F.transform(lengths, lambda length: run(start, length))))
    return F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))


def _tokens(text: str) -> Column:
    """Words in order. Words parted by anything but one space are kept apart by a mark no name has."""
    marked = F.regexp_replace(text, r"[^\p{L} ][^\p{L}]*| [^\p{L}]+", " | ")
    return F.array_remove(F.split(marked, " "), "")


_FOUND = "array<struct<name:string,label:string>>"


def candidate_runs(texts: DataFrame, names: DataFrame, row_id: str) -> DataFrame:
    """(row_id, _run): the runs of words of each text that begin like a name and are as long as one.

    ``texts`` has the row id and ``_tokens``; ``names`` the ``_run`` of each name. Texts without such a word give no
    row. The index has one row per first word; it is measured, and joined to the words of the texts where it is long.
    """
    parts = F.split("_run", " ")
    index = names.select(parts[0].alias("_word"), F.size(parts).alias("_words")).distinct()
    lengths = [r[0] for r in index.select("_words").distinct().orderBy("_words").collect()]  # few: lengths of names
    listed = [r[0] for r in index.select("_word").distinct().limit(INDEX_WORDS + 1).collect()]
    if len(listed) <= INDEX_WORDS:
        places = F.transform("_tokens", lambda word, at: F.when(word.isin(listed), at))
        starts = F.filter(places, lambda at: at.isNotNull())
        runs = runs_at(F.col("_tokens"), starts, F.array(*[F.lit(n) for n in lengths]))
        return exploded(texts, [row_id], runs, "_run")
    words = F.array_distinct("_tokens")
    found = lookup_join(exploded(texts, [row_id], words, "_word"), index, ["_word"], row_id, "inner")
    # words of one text that begin names, with the lengths of those names: bounded by the text's own words
    begin = found.groupBy(row_id).agg(F.collect_set("_word").alias("_begin"), F.collect_set("_words").alias("_lengths"))
    places = F.transform("_tokens", lambda word, at: F.when(F.array_contains("_begin", word), at))
    starts = F.filter(places, lambda at: at.isNotNull())
    return exploded(texts.join(begin, row_id), [row_id], runs_at(F.col("_tokens"), starts, F.col("_lengths")), "_run")


def _found(df: DataFrame, gazetteer: DataFrame, row_id: str, text: str) -> DataFrame:
    """Names in each text by a join on the candidate runs; for name lists of any length."""
    names = (gazetteer.select("name", "label").dropna().distinct()
             .withColumn("_run", F.array_join(_tokens("name"), " ")).where("_run <> ''"))
    tokens = computed_once(df.select(row_id, text), {"_tokens": _tokens(text)})
    found = lookup_join(candidate_runs(tokens, names, row_id), names, ["_run"], row_id, "inner")
    # names of one text: bounded by its own words
    per_text = found.groupBy(row_id).agg(F.collect_list(F.struct("name", "label")).alias("_found"))
    there = F.filter(F.coalesce("_found", F.array().cast(_FOUND)), lambda e: F.contains(F.col(text), e["name"]))
    return df.join(per_text, row_id, "left").withColumn("_found", there)


def with_names(df: DataFrame, gazetteer: DataFrame, row_id: str, text: str = "text", names: str = "names") -> DataFrame:
    """The texts with their known names as a column of ``pii.NAMES``, for ``pii_detection``."""
    listed = F.transform("_found", lambda e: F.struct(e["label"].alias("label"), e["name"].alias("name")))
    return _found(df, gazetteer, row_id, text).withColumn(names, listed).drop("_found")


def with_entities(df: DataFrame, gazetteer: DataFrame, row_id: str, text: str = "text",
                  friendly: bool = False) -> DataFrame:
    """The texts with ``entities`` (``LABEL: name``, in text order) and ``redacted_text``.

    ``gazetteer`` has ``name`` (any number of words and the marks between them) and ``label``; entries that
    repeat or lack either count once or not at all. A name counts where it stands as whole words with the
    same marks between them. Redaction then replaces it wherever its letters stand, within longer words
    too, longer names before shorter ones, so that a name within a longer one stays whole.
    """
    joined = _found(df, gazetteer, row_id, text)
    placed = F.array_sort(F.transform("_found", lambda e: F.struct(
        F.position(e["name"], F.col(text)).alias("at"),
        e["label"].alias("label"), e["name"].alias("name"))))
    by_length = F.array_sort(F.transform("_placed", lambda e: F.struct(
        (-F.length(e["name"])).alias("order"), e["name"].alias("name"), e["label"].alias("label"))))
    redacted = F.aggregate(by_length, F.col(text), lambda t, e: F.replace(
        t, e["name"], redaction_tag_column(e["label"], friendly)))
    return (joined.withColumn("_placed", placed)
            .withColumn("entities", F.transform(
                "_placed", lambda e: F.concat(e["label"], F.lit(": "), e["name"])))
            .withColumn("redacted_text", redacted)
            .drop("_found", "_placed"))
