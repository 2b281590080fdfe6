"""Substring dedup with prefix-partitioned suffix trees, over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from hirelens.llm._common import ODD, arrow_map, durable, range_hashes, unused, words, written
from hirelens.llm.winnowing import window_minima

MIN_WORDS, GRAM = 50, 20
#: Places up to which a prefix's suffixes form one group; some 50 MB with their texts.
MOST_PLACES = 50_000


def anchors(h: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of words, and for each suffix of `least` words or more, at which gram its prefix ends: the rightmost gram of least hash among the first `least` words."""
    if len(h) < least:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.arange(len(h) - gram + 1)
    g = range_hashes(h, first, first + gram, ODD ^ 0x5A5A5A5A00)
    return g, window_minima(g, least - gram + 1)


Place = tuple[int, int, int]


def deep_nodes(segments: list[bytes], least: int) -> list[list[tuple[int, int, int, int]]]:
    """The subtree of one prefix group, as its sorted suffixes: for each topmost node at least `least` words deep the leaves (segment, suffix, its words, words in common with the leaf before) below it, in order. A suffix alone is returned too, as its segment can stand at several places."""
    leaves = []
    for i, seg in enumerate(segments):
        b = np.frombuffer(seg, np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts = np.concatenate([[0], gaps + 1])[: len(gaps) + 2 - least]
        ends = np.append(gaps, len(seg))[least - 1 :]
        leaves += [(seg[s:], e - s, i, j, len(gaps) + 1 - j) for j, (s, e) in enumerate(zip(starts.tolist(), ends.tolist()))]
    leaves.sort()
    nodes, before, last = [], b"", b""
    for suffix, deep, i, j, many in leaves:
        if nodes and len(before) == deep and suffix.startswith(before):
            nodes[-1].append((i, j, many, common_words(last, suffix)))
        else:
            nodes.append([(i, j, many, 0)])
            before = suffix[:deep]
        last = suffix
    return nodes


def common_words(a: bytes, b: bytes) -> int:
    """Whole words, divided by one space each, with which both begin."""
    m = min(len(a), len(b))
    if a[:m] != b[:m]:
        m = int((np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)).argmax())
        return a[:m].count(b" ")
    return a[:m].count(b" ") + (len(a) == len(b) or (a if len(a) > m else b)[m] == 32)


def earlier_places(common: list[int], lows: list[Place]) -> list[list[tuple[int, Place]]]:
    """Of each leaf the places that its ancestors have before its own, as (the ancestor's depth in words, its least place), deepest first; common: words in common with the leaf before, lows: each leaf's least place.

    The tree's internal nodes are the intervals of common-prefix lengths, opened and closed on a stack."""
    depth, parent, own, stack = [-1], [0], [0] * len(lows), [0]
    for k, d in enumerate(common):
        below = None
        while k and depth[stack[-1]] > d:
            below = stack.pop()
            if depth[stack[-1]] >= d:
                parent[below], below = stack[-1], None
        if k and depth[stack[-1]] < d:
            depth.append(d)
            parent.append(0)
            stack.append(len(depth) - 1)
            if below is None:
                own[k - 1] = stack[-1]
            else:
                parent[below] = stack[-1]
        own[k] = stack[-1]
    for above, n in zip(stack, stack[1:]):
        parent[n] = above
    low: dict[int, Place] = {}
    for n, place in zip(own, lows):
        low[n] = min(place, low.get(n, place))
    for n in sorted(range(1, len(depth)), key=lambda n: -depth[n]):
        low[parent[n]] = min(low[n], low.get(parent[n], low[n]))
    out = []
    for n, place in zip(own, lows):
        chain: list[tuple[int, Place]] = []
        while n:
            if low[n] != (chain[-1][1] if chain else place):
                chain.append((depth[n], low[n]))
            n = parent[n]
        out.append(chain)
    return out


def group_ranges(places: dict[bytes, set[Place]], least: int) -> Iterator[tuple[int, int, bool, int, int]]:
    """places: where (doc_id, text_hash, first word) each distinct segment of a group stands. To (doc_id, text_hash, again, start, end) of the words of each repeat: an occurrence that isn't the first reaches as far as the deepest node that has an earlier one, the first as far as is asked at least."""

    def later(place: Place, shift: int, many: int, first: Place) -> Iterator[tuple[int, int, bool, int, int]]:
        doc, text, at = place
        s, e = at + shift, at + shift + many
        # what overlaps its own first occurrence leaves that whole
        s = max(s, first[2] + least) if (doc, text) == first[:2] else s
        if s < e:
            yield doc, text, True, s, e

    segments = list(places)
    if len(segments) == 1:
        where = places[segments[0]]
        if len(where) > 1:
            first, many = min(where), segments[0].count(b" ") + 1
            yield *first[:2], False, first[2], first[2] + many
            for place in where - {first}:
                yield from later(place, 0, many, first)
        return
    for node in deep_nodes(segments, least):
        at = [[(doc, text, s + j) for doc, text, s in places[segments[i]]] for i, j, _, _ in node]
        lows = [min(x) for x in at]
        low = min(lows)
        if len(node) > 1 or len(at[0]) > 1:
            yield *low[:2], False, low[2], low[2] + least
        for (_, _, many, _), every, own, chain in zip(node, at, lows, earlier_places([x[3] for x in node], lows)):
            for place in every:
                # leaves of one suffix are a node as deep as it is cut
                for depth, first in [(many, own), *chain] if place != own else chain:
                    yield from later(place, 0, depth, first)
                    if first[:2] != place[:2]:
                        break  # what is less deep is less long


def merged(rows: Iterator[tuple[int, int, bool, int, int]]) -> Iterator[tuple[int, int, bool, int, int]]:
    """Unions of ranges that meet; rows come sorted."""
    held = None
    for row in rows:
        if held and held[:3] == row[:3] and row[3] <= held[4]:
            held = (*held[:4], max(row[4], held[4]))
        else:
            if held:
                yield held
            held = row
    if held:
        yield held


def repeats(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM, most: int = MOST_PLACES) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, text_hash, again, start_word, end_word): the unions of all passages of `least` words or more that stand more than once, in one document or several. Of each passage, the occurrence of least (doc_id, text_hash, word) has again = false, and the others true.

    The suffix at each word belongs to the prefix that ends with its anchor, the gram of least hash among its first `least` words; so prefixes vary in length from `gram` to `least` words, and equal suffixes have equal prefixes. 1. Each document's anchors are counted over the corpus, summed up before they are shuffled; prefixes of one suffix are leaves and go. 2. Prefixes of up to `most` places: their suffixes, as one segment of text for each anchor, shuffle to their group, which so fits in memory. A group's suffixes are sorted, their common prefixes' lengths give the subtree's internal nodes, and those at least `least` words deep the repeats: a later occurrence is one down to its deepest node that has an earlier one too. 3. Prefixes of more places are lengthened to all of their `least` words; each of those is a node by itself, whose first place is found by an aggregation, so that no task has to hold its places.

    Words are divided by spaces and control characters (UTF-8 bytes up to 32) and compared as they are. Rows without doc_id or text and texts under `least` words give nothing, nor does an empty table. Rows that repeat a doc_id with the same text are one document, with other texts as many, which text_hash (xxhash64 of the text) tells apart; other columns don't matter. A passage that overlaps its own first occurrence is a repeat from that occurrence's end on."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")

    def count(x: dict) -> Iterator[dict]:
        for k in range(0, len(x["text"]), 500):
            ids, hs, ps = [], [], []
            for doc, t in zip(x["doc_id"][k : k + 500], x["text"][k : k + 500]):
                g, at = anchors(words(t)[3], least, gram)
                at = at[np.flatnonzero(np.diff(at, prepend=-1))]
                ids.append(np.full(len(at), doc, np.int64))
                hs.append(g[at].view(np.int64))
                ps.append(at.astype(np.int32))
            yield {"doc_id": np.concatenate(ids), "h": np.concatenate(hs), "at": np.concatenate(ps)}

    found = written(arrow_map(texts, count, "doc_id bigint, h bigint, at int"))
    many = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > most).alias("hot"))
    # a document's own anchors, whose number its length bounds
    shared = found.join(many, "h").groupBy("doc_id").agg(F.collect_set(F.struct("at", "hot")).alias("anchors"))

    def cut(x: dict) -> Iterator[dict]:
        for k in range(0, len(x["text"]), 500):
            out: dict = {c: [] for c in ("h", "h2", "doc_id", "text_hash", "start", "segment")}
            for doc, key, t, wanted in zip(x["doc_id"][k : k + 500], x["text_hash"][k : k + 500], x["text"][k : k + 500], x["anchors"][k : k + 500]):
                b, s, e, h = words(t)
                g, at = anchors(h, least, gram)
                wanted = sorted((w["at"], w["hot"]) for w in wanted)
                place = np.array([w for w, _ in wanted], np.int64)
                first, last = np.searchsorted(at, place), np.searchsorted(at, place, "right")
                ends = np.cumsum(e - s + 1)
                starts = ends - (e - s + 1)
                plain = b" ".join(np.where(b > 32, b, 32).astype(np.uint8).tobytes().split())
                for (a, hot), lo, hi in zip(wanted, first.tolist(), last.tolist()):
                    if lo < hi and hot:
                        p = np.arange(lo, hi)
                        for c, v in (("h", range_hashes(h, p, p + least).view(np.int64).tolist()), ("h2", range_hashes(h, p, p + least, ODD ^ 0x3C3C3C3C00).view(np.int64).tolist()), ("doc_id", [doc] * len(p)), ("text_hash", [key] * len(p)), ("start", p.tolist()), ("segment", [None] * len(p))):
                            out[c] += v
                    elif lo < hi:
                        for c, v in (("h", int(g[a].view(np.int64))), ("h2", None), ("doc_id", doc), ("text_hash", key), ("start", lo), ("segment", plain[starts[lo] : ends[hi + least - 2] - 1])):
                            out[c].append(v)
            yield out

    suffixes = arrow_map(texts.join(shared, "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "anchors"), cut, "h bigint, h2 bigint, doc_id bigint, text_hash bigint, start int, segment binary")
    if many.filter("hot").limit(1).count():
        suffixes = written(suffixes)
        whole = suffixes.filter("segment is null").select("h", "h2", F.struct("doc_id", "text_hash", "start").alias("place"))
        first = whole.groupBy("h", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("first <> last")
        again = F.col("place") != F.col("first")
        own = again & (F.col("place.doc_id") == F.col("first.doc_id")) & (F.col("place.text_hash") == F.col("first.text_hash"))
        start = F.when(own, F.greatest("place.start", F.col("first.start") + least)).otherwise(F.col("place.start"))
        hot = whole.join(first, ["h", "h2"]).select("place.doc_id", "place.text_hash", again.alias("again"), start.cast("int").alias("start_word"), (F.col("place.start") + least).cast("int").alias("end_word")).filter("start_word < end_word")
        segments = suffixes.filter("segment is not null").drop("h2")
    else:
        hot, segments = None, suffixes.drop("h2")

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (("doc_id", pa.int64()), ("text_hash", pa.int64()), ("again", pa.bool_()), ("start_word", pa.int32()), ("end_word", pa.int32()))
        return pa.RecordBatch.from_pydict({c: pa.array(x, kind) for (c, kind), x in zip(kinds, zip(*rows))})

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, places, out = None, {}, []

        def merge_group() -> None:
            if len(places) > 1 or any(len(x) > 1 for x in places.values()):
                out.extend(merged(iter(sorted(group_ranges(places, least)))))

        for batch in batches:
            for h, doc, key, start, seg in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "text_hash", "start", "segment"))):
                if h != prefix:
                    merge_group()
                    prefix, places = h, {}
                    if len(out) > 50_000:
                        yield pack(out)
                        out.clear()
                places.setdefault(seg, set()).add((doc, key, start))
        merge_group()
        if out:
            yield pack(out)

    ranges = segments.repartition("h").sortWithinPartitions("h").mapInArrow(grow, RANGES)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("doc_id", "text_hash", "again", "start_word", "end_word")))

        out = []
        for row in merged(rows()):
            out.append(row)
            if len(out) == 50_000:
                yield pack(out)
                out = []
        if out:
            yield pack(out)

    ranges = ranges if hot is None else ranges.union(hot)
    return ranges.repartition("doc_id").sortWithinPartitions("doc_id", "text_hash", "again", "start_word", "end_word").mapInArrow(join_up, RANGES)


RANGES = "doc_id bigint, text_hash bigint, again boolean, start_word int, end_word int"


def cut_ranges(text: str, ranges: list[tuple[int, int]]) -> str:
    """text without the words start..end of each range, and the space that follows them."""
    b, s, _, _ = words(text)
    edge = np.append(s, len(b))
    keep = np.ones(len(b), bool)
    for lo, hi in ranges:
        keep[edge[lo] : edge[hi]] = False
    return b[keep].tobytes().decode("utf-8", "surrogatepass").rstrip() if len(ranges) else text


def without_repeats(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """docs, each repeated passage cut from all documents but the first it stands in; columns as they are, n_chars (if there) counted anew.

    Documents of which nothing is left go. Those without repeats stay as they are, those without doc_id or text too, and so do the empty ones. Rows alike in doc_id and text are cut alike; rows of one doc_id with other texts are documents of their own. Columns may have any other names; an empty table gives an empty one."""
    gone = repeats(docs, least, gram).filter("again").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("gone"))
    names, kinds = docs.columns, to_arrow_schema(docs.schema)
    cut_id, cut_hash, cut_at = unused(docs, "cut_id"), unused(docs, "cut_hash"), unused(docs, "cut_at")
    gone = durable(gone.select(F.col("doc_id").alias(cut_id), F.col("text_hash").alias(cut_hash), F.col("gone").alias(cut_at)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, ranges = {c: b.column(k) for k, c in enumerate(names)}, b.column(len(names)).to_pylist()
            texts = [t if g is None else cut_ranges(t, [(x["start_word"], x["end_word"]) for x in g]) for t, g in zip(columns["text"].to_pylist(), ranges)]
            columns["text"] = pa.array(texts, kinds.field("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([n if g is None else len(t) for n, t, g in zip(columns["n_chars"].to_pylist(), texts, ranges)], kinds.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array([g is None or t != "" for g, t in zip(ranges, texts)], pa.bool_()))

    joined = docs.join(gone, (F.col("doc_id").cast("bigint") == F.col(cut_id)) & (F.xxhash64("text") == F.col(cut_hash)), "left")
    return joined.select(*[docs[c] for c in names], cut_at).mapInArrow(cut, docs.schema)


#: repeats over documents, whose doc_ids are unique, without text_hash: all windows of 50 words.
SQL = f"""
WITH words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x{{00}}-\\x{{20}}]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
windows AS (SELECT doc_id, k, md5(string_agg(word, ' ') OVER near) AS h, count(*) OVER near AS n FROM words WINDOW near AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
found AS (SELECT doc_id, k, first_value(doc_id) OVER w AS first_doc, first_value(k) OVER w AS first_k, count(*) OVER (PARTITION BY h) AS many FROM windows WHERE n = {MIN_WORDS} WINDOW w AS (PARTITION BY h ORDER BY doc_id, k)),
cut AS (SELECT doc_id, (doc_id, k) <> (first_doc, first_k) AS again, CASE WHEN (doc_id, k) <> (first_doc, first_k) AND doc_id = first_doc THEN greatest(k, first_k + {MIN_WORDS}) ELSE k END AS lo, k + {MIN_WORDS} AS hi FROM found WHERE many > 1),
held AS (SELECT *, max(hi) OVER (PARTITION BY doc_id, again ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cut WHERE lo < hi),
islands AS (SELECT *, sum(CASE WHEN before >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, again ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM held)
SELECT doc_id, again, CAST(min(lo) AS INTEGER) AS start_word, CAST(max(hi) AS INTEGER) AS end_word FROM islands GROUP BY doc_id, again, island"""
