"""Substring deduplication: shared k-mer seeds, collinear chains through a Fenwick tree, aligned passages.

Every document keeps the least hashes of its word 5-grams per window as seeds. A seed that stands in
several documents links each of them to the first one that holds it, so that a passage with any number of
copies costs one link per copy. Links between two documents are chained in order, chains, those of one link too, are
aligned word by word, and what is similar over fifty words or more is a repeated passage. Seeds whose link was
refuted, since their first document holds them by chance, are linked once more, by the pair of the seed and the next.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, mixed, over_batches, split_words, word_hashes

SEED_WORDS = 5        # words of a seed
WINDOW = 10           # of as many neighbouring seeds one is kept: any 14 equal words share a seed
MIN_WORDS = 50        # words of a passage
MIN_FRAGMENT = 12     # words an aligned chain needs to count towards a passage
MIN_SIMILARITY = 0.8  # share of equal words in an alignment
JOIN_WORDS = 3        # words between fragments of one passage
GAP_COST = 0.05       # per word of distance, on either side, against SEED_WORDS a seed is worth
REACH = MIN_WORDS + WINDOW   # words an alignment may go beyond the outer seeds of its chain


def kept_seeds(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds kept of texts laid end to end: the least of every window."""
    count = len(words) - SEED_WORDS + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = np.zeros(count, np.uint64)
    for i in range(SEED_WORDS):
        hashes = mixed(hashes + words[i:i + count])
    inside = np.ones(count, bool)
    for start in starts[1:-1]:
        inside[max(0, start - SEED_WORDS + 1):start] = False
    low = np.uint64((1 << 26) - 1)  # the place within the window rides in the lowest bits
    ranked = np.where(inside, (hashes & ~low) | (np.arange(count, dtype=np.uint64) & low), np.uint64(2**64 - 1))
    least, width = ranked, 1
    while width < WINDOW and len(least) > 1:
        step = min(width, WINDOW - width, len(least) - 1)
        least = np.minimum(least[:-step], least[step:])
        width += step
    there = least != np.uint64(2**64 - 1)
    least = least[there]
    # text boundaries: a short text may lie in windows whose least seed is its neighbour's
    new = np.concatenate([[True], least[1:] != least[:-1]])[:len(least)]
    offset = (least[new] & low).astype(np.int64) - np.flatnonzero(there)[new] % (1 << 26)
    at = np.flatnonzero(there)[new] + offset % (1 << 26)
    places = np.unique(np.concatenate([at, _edges(ranked, inside, starts)]))
    return places, hashes[places]


def _edges(ranked: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least seed of the first and of the last window of every text."""
    found = []
    for a, b in zip(starts[:-1], starts[1:] - SEED_WORDS + 1):
        b = min(b, len(ranked))
        if b > a:
            found.append(a + int(ranked[a:min(b, a + WINDOW)].argmin()))
            last = max(a, b - WINDOW)
            found.append(last + int(ranked[last:b].argmin()))
    return np.array(found, np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, words, seeds): one byte per word, and the seeds as (h, pair, pos), ``pair`` a hash of the seed and the
    next one of the text, null for the last."""
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, starts = split_words(batch.column(2))
        words = word_hashes(values)
        places, hashes = kept_seeds(words, starts)
        cut = np.searchsorted(places, starts)
        bytes_ = (words >> np.uint64(56)).astype(np.uint8).tobytes()
        after = np.concatenate([hashes[1:], np.zeros(1, np.uint64)])[:len(hashes)]
        ends = np.zeros(len(hashes), bool)
        ends[cut[1:][cut[1:] > cut[:-1]] - 1] = True
        pair = pa.array(mixed(mixed(hashes) + after).view(np.int64), mask=ends)
        seeds = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(hashes.view(np.int64)), pair, pa.array((places - starts[np.searchsorted(starts, places, "right") - 1])
                                                             .astype(np.int32))], names=["h", "pair", "pos"]))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1),
             pa.array([bytes_[a:b] for a, b in zip(starts[:-1], starts[1:])], pa.binary()), seeds],
            names=["row", "id", "words", "seeds"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("string").alias("text"))
    return over_batches(rows, scan, "row long, id long, words binary, seeds array<struct<h:long,pair:long,pos:int>>")


def links(seeds: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, anchor, pos, apos, pair, id): each seed of a document and its place in the first document that has it.

    ``seeds`` has h, pair, pos, row, id. The first document of a seed is a minimum that every task takes beforehand, so
    that a seed which a third of all documents share is one row per task there. The table of shared seeds is written;
    the join reads it plainly, and adaptive execution may split the rows of a frequent seed.
    """
    shared = scratch.keep(
        seeds.groupBy("h").agg(F.min(F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "row", "pos")).alias("a"),
                               F.min("row").alias("low"), F.max("row").alias("high"))
        .where("low < high").select("h", F.col("a.row").alias("anchor"), F.col("a.pos").alias("apos")))
    return scratch.keep(seeds.join(shared, "h").where("row <> anchor").select("row", "anchor", "pos", "apos", "pair", "id"))


def refuted(linked: DataFrame, found: DataFrame) -> DataFrame:
    """The seeds (h, pair, pos, row, id) of links that lie in no similar fragment, with the pair in place of the seed.

    Links and fragments of a document are sorted by place together: a link lies in a fragment if the furthest end of
    those that begin before it, or with it, lies behind it. No link is held against each fragment of its document.
    """
    both = (linked.where("pair is not null").select("row", "pos", "pair", "id", F.lit(None).cast("int").alias("end"))
            .union(found.select("row", "start", F.lit(None).cast("long"), F.lit(None).cast("long"), "end")))
    before = Window.partitionBy("row").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (both.withColumn("reach", F.max("end").over(before)).where("end is null and (reach is null or reach <= pos)")
            .select(F.col("pair").alias("h"), "pair", "pos", "row", "id"))


def chained(pos: np.ndarray, apos: np.ndarray) -> list[np.ndarray]:
    """Chains of links, as index arrays: links in order in both texts, the dearest chain first.

    A link is worth its words; a step costs GAP_COST for each word passed in either text, which adds up over
    a chain. The best predecessor with a smaller place in the other text is therefore a prefix maximum of
    score + cost of the place, kept in a Fenwick tree, and links are visited in the order of their own text.
    """
    order = np.lexsort((-apos, pos))
    ranks = np.unique(apos, return_inverse=True)[1] + 1
    size = int(ranks.max()) + 1
    tree_value, tree_link = [-1e18] * (size + 1), [-1] * (size + 1)
    score, before = np.zeros(len(pos)), np.full(len(pos), -1)
    for link in order.tolist():
        place = GAP_COST * (int(pos[link]) + int(apos[link]))
        best, come, at = -1e18, -1, int(ranks[link]) - 1
        while at > 0:
            if tree_value[at] > best:
                best, come = tree_value[at], tree_link[at]
            at -= at & -at
        score[link] = SEED_WORDS
        if come >= 0 and best - place > 0:
            score[link] += best - place
            before[link] = come
        value, at = score[link] + place, int(ranks[link])
        while at <= size:
            if value > tree_value[at]:
                tree_value[at], tree_link[at] = value, link
            at += at & -at
    chains, used = [], np.zeros(len(pos), bool)
    for link in np.argsort(-score, kind="stable").tolist():
        chain = []
        while link >= 0 and not used[link]:
            used[link] = True
            chain.append(link)
            link = int(before[link])
        if chain:
            chains.append(np.array(chain[::-1]))
    return chains


def aligned(chains: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Similar fragments (chain, start, end, start there, end there) along all chains of a batch at once.

    ``chains`` has pos, apos, words, awords, base, abase: the places of the links, the texts' words from ``base`` and
    ``abase`` on. Between two links the words are laid on the diagonal of the first up to the place that leaves most
    equal words, then on that of the second; beyond the outer links they stay on the outer diagonals.
    """
    if not len(chains):
        return (np.zeros(0, np.int64),) * 5
    pos, apos, words, awords, base, abase = chains.columns
    base, abase = np.asarray(base).astype(np.int64), np.asarray(abase).astype(np.int64)
    (data, begin, size), (adata, abegin, asize) = _bytes_of(words), _bytes_of(awords)
    links_ = np.asarray(pc.list_value_length(pos))
    chain, outer = np.repeat(np.arange(len(links_)), links_), np.cumsum(links_)
    at = np.asarray(pc.list_flatten(pos)) + (begin - base)[chain]  # places of the links in the bytes end to end
    shift = np.asarray(pc.list_flatten(apos)) + (abegin - abase)[chain] - at

    def same(at: np.ndarray, there: np.ndarray, chain: np.ndarray) -> np.ndarray:
        ok = (there >= abegin[chain]) & (there < (abegin + asize)[chain])
        return ok & (data[at] == adata[np.where(ok, there, 0)])

    turn = np.concatenate([at[1:], [0]])  # where the diagonal of the next link begins
    turn[outer - 1] = begin + size
    bent = np.ones(len(at), bool)
    bent[outer - 1] = False
    bent = np.flatnonzero(bent)
    bent = bent[shift[bent] != shift[bent + 1]]
    if len(bent):
        between, cuts = _places(at[bent], at[bent + 1])
        of = np.repeat(bent, np.diff(cuts))
        gain = np.cumsum(same(between, between + shift[of], chain[of]).astype(np.int64)
                         - same(between, between + shift[of + 1], chain[of]))
        gain -= np.repeat(np.concatenate([[0], gain])[cuts[:-1]], np.diff(cuts))
        most, step = _first_most(gain, cuts)
        turn[bent] = at[bent] + np.where(most > 0, step + 1, 0)
    before = np.concatenate([[0], turn[:-1]])
    before[outer - links_] = begin
    chain_of = np.repeat(np.arange(len(size)), size)
    own = np.arange(begin[0], begin[0] + len(chain_of))
    partner = own + np.repeat(shift, turn - before)
    equal = same(own, partner, chain_of)
    chain, first, last = similar_parts(equal, np.concatenate([[0], np.cumsum(size)]))
    move, amove = (base - begin)[chain], (abase - abegin)[chain]
    return chain, own[first] + move, own[last - 1] + 1 + move, partner[first] + amove, partner[last - 1] + 1 + amove


def similar_parts(equal: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the similar fragments of texts laid end to end between ``cuts``.

    Of each text the longest fragment is taken, then the longest of what lies before and behind it, and so on.
    """
    def laid(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, inner = _places(parts[1], parts[2])
        return equal[at], inner

    parts, found = np.stack([np.arange(len(cuts) - 1), cuts[:-1], cuts[1:]]), []
    while parts.size:
        parts = parts[:, parts[2] - parts[1] >= MIN_FRAGMENT]
        if parts.size:
            parts = parts[:, ~too_different(*laid(parts))]
        start, end = longest_spans(*laid(parts))
        similar = end - start >= MIN_FRAGMENT
        text, a, b = parts[:, similar]
        start, end = a + start[similar], a + end[similar]
        found.append(np.stack([text, start, end]))
        parts = np.concatenate([np.stack([text, a, start]), np.stack([text, end, b])], axis=1)
    return tuple(np.concatenate(found, axis=1))


def longest_spans(equal: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_span`` of every text between ``cuts``, counted from its own start; equal where there is none.

    Scores are whole numbers. Each text's lie below those of the text before, so that one running minimum of the
    beginnings and one running maximum of the ends, from behind, serve all texts.
    """
    share = Fraction(MIN_SIMILARITY).limit_denominator(1000)
    size = np.diff(cuts)
    gain = equal * np.int64(share.denominator) - share.numerator
    score = np.concatenate([[0], np.cumsum(gain)])
    lower = np.int64(4 * share.denominator) * (int(size.max(initial=0)) + 1) * np.arange(len(size)) + score[cuts[:-1]]
    lower = np.repeat(lower, size)
    far = np.iinfo(np.int64).max
    least = np.minimum.accumulate(np.where(equal, score[:-1] - lower, far))
    most = np.maximum.accumulate(np.where(equal, score[1:] - lower, -far)[::-1])
    begins = np.flatnonzero(least < np.concatenate([[far], least[:-1]]))
    length = len(equal) - np.searchsorted(most, least[begins], "left") - begins
    start, end = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    inner = np.searchsorted(begins, cuts)
    some = inner[1:] > inner[:-1]
    if some.any():
        longest, first = _first_most(length, np.concatenate([inner[:-1][some], [len(begins)]]))
        start[some] = begins[inner[:-1][some] + first] - cuts[:-1][some]
        end[some] = start[some] + longest
    return start, end


def too_different(equal: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
    """Whether no fragment can lie in the words of each text between ``cuts``; without cuts they are one text.

    A fragment has a part of ``MIN_FRAGMENT`` to twice as many words, less one, that is similar enough by itself.
    """
    cuts = np.array([0, len(equal)]) if cuts is None else cuts
    total = np.concatenate([[0], np.cumsum(equal)])
    ends = np.minimum(np.arange(len(equal)) + 2 * MIN_FRAGMENT, np.repeat(cuts[1:], np.diff(cuts)))
    return np.maximum.reduceat(total[ends] - total[:-1], cuts[:-1]) < MIN_SIMILARITY * MIN_FRAGMENT - 1e-9


def _places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places from each ``a`` up to its ``b``, end to end, and the cuts between them."""
    cuts = np.concatenate([[0], np.cumsum(b - a)])
    return np.arange(cuts[-1]) + np.repeat(a - cuts[:-1], b - a), cuts


def _first_most(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value between each two cuts, none of them empty, and the first place that has it."""
    step = np.arange(len(values)) - np.repeat(cuts[:-1], np.diff(cuts))
    ranked = np.maximum.reduceat((values << 32) - step, cuts[:-1])
    most = -(-ranked >> 32)
    return most, (most << 32) - ranked


def alone(at: np.ndarray, there: np.ndarray, words: pa.BinaryArray, awords: pa.BinaryArray) -> np.ndarray:
    """Which single links have too few equal words around them for any fragment, all at once.

    As ``too_different`` on the diagonal of each link; places beyond either text count as different.
    """
    (data, start, size), (adata, astart, asize) = _bytes_of(words), _bytes_of(awords)
    back, on = np.minimum(at, there), np.minimum(size - at, asize - there)
    width = 2 * MIN_FRAGMENT
    step = np.arange(max(width, int((back + on).max(initial=0))))
    inside = step < (back + on)[:, None]
    own = np.where(inside, (start + at - back)[:, None] + step, 0)
    other = np.where(inside, (astart + there - back)[:, None] + step, 0)
    total = np.zeros((len(at), len(step) + 1), np.int32)
    np.cumsum(inside & (data[own] == adata[other]), axis=1, out=total[:, 1:])
    return (total[:, width:] - total[:, :-width]).max(axis=1) < MIN_SIMILARITY * MIN_FRAGMENT - 1e-9


def _bytes_of(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of an array of binaries end to end, at least one, and the start and the size of each."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return data, offsets[:-1], np.diff(offsets)


def chain_links(linked: DataFrame) -> DataFrame:
    """(row, anchor, pos, apos): the chains between two documents, as arrays of places.

    Links are gathered per pair of documents, at most as many as the document has seeds.
    """
    pairs = (linked.groupBy("row", "anchor").agg(F.sort_array(F.collect_list(F.struct("pos", "apos"))).alias("m"))
             .select("row", "anchor", F.col("m.pos").alias("pos"), F.col("m.apos").alias("apos")))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        single = pc.equal(pc.list_value_length(batch.column(2)), 1)
        rows: list[tuple] = []
        for row, anchor, pos, apos in zip(*(c.to_pylist() for c in batch.filter(pc.invert(single)).columns)):
            pos, apos = np.array(pos), np.array(apos)
            rows += [(row, anchor, pos[c].tolist(), apos[c].tolist()) for c in chained(pos, apos)]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([c.cast(k), pa.array(list(more), k)]) for c, more, k in zip(
                batch.filter(single).columns, zip(*rows) if rows else [()] * 4, kinds)], names=["row", "anchor", "pos", "apos"])

    return over_batches(pairs, scan, "row long, anchor long, pos array<int>, apos array<int>")


def fragments(chains: DataFrame, sketched: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, anchor, start, end, astart, aend): the similar fragments of each chain."""
    words = sketched.select("row", "words")
    first = F.greatest(F.element_at("pos", 1) - REACH, F.lit(0))
    afirst = F.greatest(F.element_at("apos", 1) - REACH, F.lit(0))
    with_own = (chains.join(words, "row").withColumn("base", first)
                .withColumn("words", F.expr(f"substring(words, base + 1, element_at(pos, -1) - base + {SEED_WORDS + REACH})")))
    kept = scratch.keep(with_own)
    there = words.select(F.col("row").alias("anchor"), F.col("words").alias("awords"))
    both = (kept.join(there, "anchor").withColumn("abase", afirst)
            .withColumn("awords", F.expr(f"substring(awords, abase + 1, element_at(apos, -1) - abase + {SEED_WORDS + REACH})")))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        single = np.asarray(pc.equal(pc.list_value_length(batch.column(2)), 1))
        if single.any():
            links_ = batch.filter(pa.array(single))
            at, there = (np.asarray(pc.list_flatten(links_.column(i))) - np.asarray(links_.column(i + 4)) for i in (2, 3))
            kept = ~single
            kept[single] = ~alone(at, there, links_.column(4), links_.column(5))
            batch = batch.filter(pa.array(kept))
        chain, *spans = aligned(batch.select(range(2, 8)))
        chain = pa.array(chain)
        return pa.RecordBatch.from_arrays([batch.column(0).take(chain), batch.column(1).take(chain),
                                           *(pa.array(x.astype(np.int32)) for x in spans)],
                                          names=["row", "anchor", "start", "end", "astart", "aend"])

    return over_batches(both.select("row", "anchor", "pos", "apos", "words", "awords", "base", "abase"), scan,
                        "row long, anchor long, start int, end int, astart int, aend int")


def merged(spans: list[tuple[int, int]], min_words: int) -> list[tuple[int, int]]:
    """Unions of spans at most JOIN_WORDS apart that have at least ``min_words`` words."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + JOIN_WORDS:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= min_words]


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_words: int = MIN_WORDS) -> DataFrame:
    """(id, later, first, sources), one row per input row.

    ``later`` are the passages, as (start, end) in words, that an earlier document has as well and that a
    deduplication would cut; ``first`` are those that a later document repeats; ``sources`` the ids of the
    earlier documents. Earlier means a smaller id, then an earlier row; null ids come last. Words are runs of
    characters other than ASCII white space, A-Z in lower case. A passage may be put together from fragments
    with different earlier documents. Null and empty texts have none; rows that repeat are copies of each
    other; an empty table stays empty; other columns are ignored; texts of any length are read whole.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    sketched = scratch.keep(sketches(docs, id_col, text_col))
    seeds = sketched.select("row", "id", F.explode("seeds").alias("s")).select("s.h", "s.pair", "s.pos", "row", "id")
    found = linked = None
    for _ in range(2):  # by single seeds, then what they could not verify by pairs of seeds
        if found is not None:
            left = scratch.keep(refuted(linked, found).drop("pair"))  # read twice; pairs are the seeds now
            scratch.drop(linked)
            seeds = left.withColumn("pair", F.col("h"))
        linked = links(seeds, scratch)
        chains = scratch.keep(chain_links(linked))
        more = scratch.keep(fragments(chains, sketched, scratch))
        found = more if found is None else found.union(more)
    later = found.select("row", "start", "end", "anchor")
    first = found.groupBy(F.col("anchor").alias("row"), F.col("astart").alias("start")).agg(
        F.max("aend").alias("end")).select("row", "start", "end", F.lit(None).cast("long").alias("anchor"))
    gathered = later.union(first).groupBy("row").agg(F.collect_list(F.struct("start", "end", "anchor")).alias("spans"))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans in batch.column(1).to_pylist():
            both = [merged([(s["start"], s["end"]) for s in spans if (s["anchor"] is None) == first], min_words)
                    for first in (False, True)]
            rows = {s["anchor"] for s in spans if s["anchor"] is not None
                    and any(a <= s["start"] and s["end"] <= b for a, b in both[0])}
            out.append((*[[{"start": a, "end": b} for a, b in x] for x in both], sorted(rows)))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = (span, span, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(
            zip(*out) if out else [()] * 3, kinds))], names=["row", "later", "first", "rows"])

    span = "array<struct<start:int,end:int>>"
    passages = scratch.keep(over_batches(gathered, scan, f"row long, later {span}, first {span}, rows array<long>"))
    names = sketched.select(F.col("row").alias("source"), F.col("id").alias("name"))
    sources = scratch.keep(passages.select("row", F.explode("rows").alias("source")).join(names, "source")
                           .groupBy("row").agg(F.sort_array(F.collect_set("name")).alias("sources")))
    none = F.array().cast(span)
    return (sketched.select("row", "id").join(passages, "row", "left").join(sources, "row", "left").select(
        "id", F.coalesce("later", none).alias("later"), F.coalesce("first", none).alias("first"),
        F.coalesce("sources", F.array().cast("array<long>")).alias("sources")))
