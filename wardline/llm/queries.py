"""The registered queries of the operators, each over its whole table, and the SQL that gives their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    bpe, codes, leaks, lines, merkle, mixing, passages, pii, quality, secrets, simhash, tokens, vectors,
)
from wardline.llm.common import joined_spans

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _counts(kinds: tuple[str, ...]) -> list[Column]:
    """Numbers of base spans by kind."""
    return [F.size(F.filter("base", _is_kind(number))).cast("long").alias(f"n_{kind}")
            for number, kind in enumerate(kinds)]


def _is_kind(number: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == number


@_query
def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        F.col("component").alias("component_id"))


@_query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, those that go, and a hash of what stays."""
    found = lines.deduplicated(_documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"),
                        F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE["op7_line_dedup"] = """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM d),
    k AS (SELECT doc_id, pos, line,
                 translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
          GROUP BY key HAVING count(DISTINCT doc_id) > 1)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (coalesce(first >= doc_id, true)), ''))
               AS kept_sha256
    FROM k LEFT JOIN f USING (key) GROUP BY doc_id"""


@_query
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and representative of every vector."""
    found = vectors.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@_query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that overlap benchmark items, with the items and the longest overlap."""
    found = leaks.leaks(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), carry=["doc_id"])
    longest = F.array_max(F.transform("_spans", lambda s: s["words"]))
    return found.where(F.size("_spans") > 0).select(
        "doc_id", F.col("_items").alias("item_ids"), longest.cast("long").alias("longest"))


@_query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base spans by kind, and all spans with those the battery adds."""
    found = secrets.secrets(_documents(spark, folder))
    counts = _counts(secrets.KINDS[:3])
    return found.select(F.col("id").alias("doc_id"), *counts,
                        F.sha2(joined_spans("base", secrets.KINDS), 256).alias("base_sha256"),
                        joined_spans("found", secrets.KINDS).alias("spans"))


@_query
def op3_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: base spans by kind, and all spans with those contexts add."""
    found = pii.personal_data(_documents(spark, folder))
    counts = _counts(pii.KINDS[:4])
    return found.select(F.col("id").alias("doc_id"), *counts,
                        F.sha2(joined_spans("base", pii.KINDS), 256).alias("base_sha256"),
                        joined_spans("found", pii.KINDS).alias("spans"))


@_query
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and tokens of every document."""
    found = tokens.token_counts(_documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), F.col("words").alias("n_words"), F.col("tokens").alias("n_tokens"))


@_query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior label, score and decision for every document."""
    found = quality.classified(_documents(spark, folder).select("doc_id", "text"))
    return found.select("doc_id", F.round("_label", 6).alias("label"), F.round("_score", 6).alias("score"),
                        F.col("_keep").alias("keep"))


# The production mix: shares of tokens. Source src0 is held down; all other languages together, null among them, get
# what the named ones leave; topics are told by plain marks in the text.
MIX = {
    "source": {"src0": .10},
    "lang": {"en": .49, "de": .17, "fr": .17, "es": .13},
    "topic": {"legal": .08, "contact": .06, "records": .06, "prose": .80},
}


def _topic(text: Column) -> Column:
    return (F.when(F.contains(text, F.lit("icense")), "legal").when(F.contains(text, F.lit("@")), "contact")
            .when(text.rlike("[0-9]{4}"), "records").otherwise("prose"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    return mixing.mixed(docs, MIX, {"source": F.col("source"), "lang": F.col("lang"), "topic": _topic(F.col("text"))})


@_query
def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Expected and drawn copies of every document under the production mix."""
    found = mixed_documents(_documents(spark, folder).select("doc_id", "text", "source", "lang"))
    return found.select("doc_id", F.col("_tokens").alias("n_tokens"), F.round("_expected", 6).alias("expected"),
                        F.col("_copies").alias("copies"))


def _mixing_sql(sweeps: int = mixing.SWEEPS) -> str:
    """Raking as one window sum per dimension and sweep."""
    steps, last = [], "w0"
    for n in range(sweeps):
        for at, wanted in (("s", "ws"), ("l", "wl"), ("t", "wt")):
            steps.append(f"{last}{at} AS (SELECT * REPLACE (w * {wanted} / sum(w) OVER (PARTITION BY {at}) AS w) "
                         f"FROM {last})")
            last += at
        steps[-1] = steps[-1].replace(f"{last} AS", f"w{n + 1} AS", 1)
        last = f"w{n + 1}"
    present = "(SELECT sum(x) FROM (SELECT DISTINCT {0}, x{0} AS x FROM c))"
    return f"""
    WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n,
                      CASE WHEN source = 'src0' THEN source ELSE 'other' END AS s,
                      CASE WHEN lang IN ('en', 'de', 'fr', 'es') THEN lang ELSE 'other' END AS l,
                      CASE WHEN contains(text, 'icense') THEN 'legal' WHEN contains(text, '@') THEN 'contact'
                           WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'records' ELSE 'prose' END AS t
               FROM documents),
    c AS (SELECT s, l, t, sum(n)::DOUBLE AS tokens, CASE s WHEN 'src0' THEN 0.10::DOUBLE ELSE 0.90::DOUBLE END AS xs,
                 CASE l WHEN 'en' THEN 0.49::DOUBLE WHEN 'de' THEN 0.17 WHEN 'fr' THEN 0.17 WHEN 'es' THEN 0.13 ELSE 0.04 END AS xl,
                 CASE t WHEN 'legal' THEN 0.08::DOUBLE WHEN 'contact' THEN 0.06 WHEN 'records' THEN 0.06 ELSE 0.80 END AS xt
          FROM d GROUP BY s, l, t HAVING sum(n) > 0),
    w0 AS (SELECT s, l, t, tokens, tokens AS w, xs / {present.format('s')} AS ws, xl / {present.format('l')} AS wl,
                  xt / {present.format('t')} AS wt FROM c),
    {", ".join(steps)},
    f AS (SELECT s, l, t, w * sum(tokens) OVER () / sum(w) OVER () / tokens AS expected FROM {last}),
    e AS (SELECT doc_id, n, CASE WHEN n > 0 THEN coalesce(expected, 0) ELSE 0 END AS expected,
                 ('0x' || substr(md5('7:' || doc_id), 1, 12))::UBIGINT / 281474976710656.0::DOUBLE AS u
          FROM d LEFT JOIN f USING (s, l, t))
    SELECT doc_id, n AS n_tokens, round(expected, 6) AS expected,
           CAST(floor(expected) AS BIGINT) + CAST(u < expected - floor(expected) AS BIGINT) AS copies FROM e"""


ORACLE["op1_source_mixing"] = _mixing_sql()


@_query
def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with repeated passages: those with an earlier copy and those that others repeat."""
    found = passages.repeated_passages(_documents(spark, folder)).where("size(later) + size(first) > 0")
    spans = F.array_join(F.transform("later", lambda s: F.concat_ws(
        ":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    words = F.aggregate("later", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), F.size("later").cast("long").alias("n_later"),
                        F.size("first").cast("long").alias("n_first"), words.alias("repeated_words"),
                        spans.alias("later_spans"), F.col("sources").alias("source_ids"))


@_query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Code and error of every usable vector, the error of its label, and the digest of the codebooks."""
    found, books = codes.compressed(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return found.select(F.col("id").alias("vec_id"), codes.code_text(F.col("codes")).alias("code"), "error",
                        "label_error", F.lit(codes.books_sha256(books)).alias("codebooks_sha256"))


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Assignment of every part to all entries, once per round."""
    def assigned(book: str) -> str:
        return (f"SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM ("
                f"SELECT vec_id, part, entry, sum((c - e) * (c - e)) AS d FROM x JOIN {book} USING (part, pos) "
                f"GROUP BY vec_id, part, entry) GROUP BY vec_id, part")

    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({assigned(f'b{n}')})")
        steps.append(f"""b{n + 1} AS MATERIALIZED (
        SELECT part, entry, pos, coalesce(m, e) AS e FROM b{n} LEFT JOIN (
            SELECT part, entry, pos, floor(sum(c)::DOUBLE / count(*))::BIGINT AS m FROM x JOIN a{n} USING (vec_id, part)
            GROUP BY part, entry, pos) USING (part, entry, pos))""")
    return f"""
    WITH v AS (SELECT vec_id, label, embedding FROM embeddings
               WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: isfinite(c))) = len(embedding)),
    x AS MATERIALIZED (
        SELECT vec_id, i // (n // 8) AS part, i % (n // 8) AS pos, floor(embedding[i + 1]::DOUBLE * 4096)::BIGINT AS c
        FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(len(embedding))) AS i FROM v)),
    b0 AS MATERIALIZED (SELECT part, entry, pos, c AS e FROM x JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 16) USING (vec_id)),
    {", ".join(steps)},
    f AS MATERIALIZED ({assigned(f"b{rounds}")}),
    r AS (SELECT vec_id, label, code, error FROM v JOIN (
        SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
        FROM f GROUP BY vec_id) USING (vec_id))
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
    FROM r"""


ORACLE["op11_vector_codes"] = _codes_sql()


@_query
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    found = bpe.decoded(bpe.encoded(_documents(spark, folder)))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@_query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its row as of now, tampered or not, leads to the root."""
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(hit & text.isNotNull(), merkle.document_leaf(merkle.lowered(text)))
    found = merkle.manifest(_documents(spark, folder), merkle.document_leaf(text), carry={"tampered": tampered})
    return (found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
            .select(F.col("id").alias("doc_id"), merkle.hex_of(F.col("leaf")).alias("leaf"),
                    merkle.hex_of(F.col("subroot")).alias("subroot"), "root",
                    F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _merkle_sql() -> str:
    """Both trees as recursive queries from the leaves up, and the proofs as recursive walks up the runs."""
    def leaf(text: str) -> str:
        fields = [f"({text})" if name == "text" else f"{name}::VARCHAR" for name in merkle.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),"
           " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: "
           "xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)")
    return f"""
    WITH RECURSIVE leaf AS (
        SELECT doc_id, lang, {leaf('text')} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END
            AS h2, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
        FROM documents),
    tree AS (SELECT lang, 0 AS lvl, i, n, h FROM leaf UNION ALL
             SELECT lang, lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM tree
             WHERE n > 1 GROUP BY lang, lvl, i // 8, (n + 7) // 8),
    sub AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
            FROM tree WHERE n = 1),
    top AS (SELECT 0 AS lvl, i, n, h FROM sub UNION ALL
            SELECT lvl + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top
            WHERE n > 1 GROUP BY lvl, i // 8, (n + 7) // 8),
    inner_runs AS (SELECT coalesce('=' || lang, '') AS grp, lvl, i // 8 AS run, list(h ORDER BY i) AS hs
                   FROM tree WHERE n > 1 GROUP BY lang, lvl, i // 8),
    outer_runs AS (SELECT lvl, i // 8 AS run, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY lvl, i // 8),
    low AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, 0 AS lvl, i, h2 AS f, '' AS proof FROM leaf UNION ALL
            SELECT doc_id, grp, lvl + 1, i // 8,
                   sha256(array_to_string(hs[:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], '')),
                   proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
            FROM low JOIN inner_runs r USING (grp, lvl) WHERE r.run = low.i // 8),
    mid AS (SELECT doc_id, grp, f, proof FROM low QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)),
    high AS (SELECT doc_id, 0 AS lvl, i, f, proof FROM mid JOIN sub ON grp = coalesce('=' || lang, '') UNION ALL
             SELECT doc_id, lvl + 1, i // 8,
                    sha256(array_to_string(hs[:i % 8], '') || f || array_to_string(hs[i % 8 + 2:], '')),
                    proof || array_to_string(hs[:i % 8], '') || array_to_string(hs[i % 8 + 2:], '')
             FROM high JOIN outer_runs r USING (lvl) WHERE r.run = high.i // 8),
    done AS (SELECT doc_id, f, proof FROM high QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id)),
    root AS (SELECT h FROM top WHERE n = 1)
    SELECT doc_id, leaf.h AS leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root,
           f = root.h AS verified
    FROM leaf JOIN done USING (doc_id) JOIN sub ON leaf.lang IS NOT DISTINCT FROM sub.lang, root"""


ORACLE["op13_merkle_manifest"] = _merkle_sql()
