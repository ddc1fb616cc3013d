"""N-gram Jaccard join with set-relation skipping (dealt operator 6).

A document's set is its distinct word shingles.  Two documents link when their sets' Jaccard
similarity is at least ``similarity`` percent; the result is each document's connected component, its
class (documents of equal sets) and, from ``links``, how many other classes it links to.

1. Blocks send their distinct shingles with the number of different sets that hold them; ranges
   return a rarity level (0: one set only).  A shingle of one set cannot be shared, so a set with too
   many of them has no partner and is done; all others keep their shared shingles, rarest first.
2. Equal sets become one class before anything else (a group of copies is one set from here on).
3. Index lists hold, for each shingle of a class's prefix (the rarest ones, of which linked sets must
   share one), the class, its size and the shingle's position.  A list is sorted by size and cut into
   blocks that carry the most that can still follow a position; a set skips whole blocks by size and
   by position.
4. Answers are derived from those of similar sets: the first pass joins each list's sets with one or
   two others only.  A set linked to another has its component, so that pairs in one component are
   never asked for again; the second pass asks for all pairs of a list that are still apart, and the
   verified ones complete the components.  That is enough for connectivity; nothing is capped.
5. A set's partners are all in its component, so every pair of a component is judged there.  A
   component is dealt into groups of bounded size and each pair of groups is one task's work: sets are
   held as differences from one of them, |A & B| = |C| - |C - A| - |C - B| + the differences that A
   and B share, so that shingles in which at most one set differs cost nothing.

Defined cases: a null text or one without words has no set and is its own component; with fewer words
than a shingle the whole sequence is one shingle; rows that share a number are separate documents
whose component is the smallest number in it; a null number names nothing (its component is the
smallest of the others, or null); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import blocks as B
from revlens.llm.arrays import PLAIN, P_WORD, U, Texts, hash_spans, mix, run_starts, word_hash, words_of

WIDTH = 5
SIMILARITY = 75
LEVELS = 1
#: Shingles are counted by 48 bits of their hashes: two that share them count as one that is shared,
#: which keeps a set that might have been told apart, and never drops one.
COUNTED = U(0xFFFFFFFFFFFF0000)
SKIP = 64  # sets in a block of an index list
FEW_PAIRS = 20_000
FAMILY = 8  # longer lists are worth a second pair for each set before all open pairs are asked for
GROUP = 256  # classes of a component that are compared with as many others at a time
GROUP_ITEMS = 1 << 17  # and their shingles
COLUMNS = 4096
PACKED = "part binary, chunk int, chunks int, body binary, counts binary"
ROWS = "block long, row long, doc_id long, n_shingles long, node binary, alone long, rest binary"
PAIRS = "a binary, b binary"


def sets_of(column: pa.Array, width: int):
    """Distinct shingles (sorted by row, then hash), rows of them, sizes, and 128-bit set names."""
    t = Texts.of(column).lowered()
    w = words_of(t, PLAIN)
    h = word_hash(t, w)
    size = np.minimum(w.per_doc, width)
    many = np.where(size > 0, w.per_doc - size + 1, 0)
    row = np.repeat(np.arange(t.n), many)
    start = w.first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    s = hash_spans(h, start, start + size[row], P_WORD)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    heads = run_starts(row, s)
    s, row = s[heads], row[heads]
    n = np.bincount(row, minlength=t.n)
    first = np.append(0, np.cumsum(n))
    names = np.zeros((t.n, 2), U)
    some = n > 0
    if len(s):
        names[some, 0] = np.add.reduceat(mix(s ^ U(0x5555555555555555)), first[:-1][some])
        names[some, 1] = np.add.reduceat(mix(s ^ U(0x3333333333333333)), first[:-1][some])
    names[:, 1] ^= n.astype(U)
    return s, row, n, names


def _distinct(s, row, names):
    """Distinct shingles of a block, the number of different sets with each, and each one's index."""
    _, one, same = np.unique(names.view([("a", U), ("b", U)]).reshape(-1), return_index=True, return_inverse=True)
    lead = one[same] == np.arange(len(names))
    distinct, index = np.unique(s & COUNTED, return_inverse=True)
    return distinct, np.bincount(index, lead[row], len(distinct)).astype(np.uint32), index


def _levels(items, sender):
    name, count = items
    order = np.argsort(name, kind="stable")
    group = np.cumsum(run_starts(name[order])) - 1
    total = np.bincount(group, count[order]) if len(name) else np.zeros(0)
    out = np.zeros(len(name), np.uint8)
    out[order] = np.ceil(np.log2(np.maximum(total, 1))).astype(np.uint8)[group] if len(name) else 0
    return out


def _rows(blocks: DataFrame, width: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    n_ranges = B.ranges(blocks.sparkSession)

    def send(block, t):
        s, row, _, names = sets_of(t[text_col], width)
        distinct, count, _ = _distinct(s, row, names)
        return B.sends(block, n_ranges, distinct, count)

    def apply(block, t, marks):
        s, row, n, names = sets_of(t[text_col], width)
        distinct, _, index = _distinct(s, row, names)
        level = B.answers(marks, LEVELS, len(distinct), np.uint8)[index]
        alone = np.bincount(row, level == 0, t.num_rows).astype(np.int64) if len(s) else np.zeros(t.num_rows, np.int64)
        alive = (n > 0) & (100 * (n - alone) >= similarity * n)
        keep = (level > 0) & alive[row]
        s, row, level = s[keep], row[keep], level[keep]
        order = np.lexsort((s, level, row))
        s, level = s[order], level[order]
        ends = np.append(0, np.cumsum(np.bincount(row, minlength=t.num_rows)))
        rest = [s[ends[i] : ends[i + 1]].tobytes() if alive[i] else None for i in range(t.num_rows)]
        node = [names[i].tobytes() if n[i] else None for i in range(t.num_rows)]
        return pa.table({"block": np.full(t.num_rows, block), "row": np.arange(t.num_rows), "doc_id": t[id_col].cast(pa.int64()), "n_shingles": n, "node": pa.array(node, pa.binary()), "alone": alone, "rest": pa.array(rest, pa.binary())})

    levels = B.meet(B.each_block(blocks, send, B.SENT), _levels, LEVELS)
    return B.with_answers(blocks, levels, apply, ROWS)


def _postings(classes: DataFrame, similarity: int) -> DataFrame:
    """Index lists, packed by range of shingles: shingle, class (an index into the row's own table), size, position, component."""
    n_ranges = B.ranges(classes.sparkSession)

    def run(batches):
        for b in batches:
            n = np.asarray(b.column(b.schema.get_field_index("n_shingles")), np.int64)
            alone = np.asarray(b.column(b.schema.get_field_index("alone")), np.int64)
            rest = [np.frombuffer(x.as_py(), U) for x in b.column(b.schema.get_field_index("rest"))]
            size = np.array([len(x) for x in rest], np.int64)
            take = np.minimum(np.maximum(n - (similarity * n + 99) // 100 + 1 - alone, 0), size)
            s = np.concatenate([x[:k] for x, k in zip(rest, take)]) if len(rest) else np.zeros(0, U)
            who = np.repeat(np.arange(len(n)), take)
            pos = alone[who] + np.arange(len(who)) - np.repeat(np.cumsum(take) - take, take)
            order = np.argsort(s, kind="stable")
            s, who, pos = s[order], who[order], pos[order]
            node, part = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), U).reshape(-1, 2) for c in ("node", "part"))

            def table(a, z):
                used, again = np.unique(who[a:z], return_inverse=True)
                return [again.astype(np.uint32), n[used].astype(np.uint32), node[used].reshape(-1), part[used].reshape(-1)]

            yield from B.sends(0, n_ranges, s, pos.astype(np.uint32), beside=table).to_batches()

    return classes.select("node", "n_shingles", "alone", "rest", "part").mapInArrow(B.task_gives_back(run), B.SENT)


def _lists(t: pa.Table):
    """Members of a range's index lists, sorted by shingle, then size."""
    cols, at = [], 0
    for x in t["body"]:
        s, pos, who, n, node, part = B.load(x.as_py())
        cols.append((s, pos.astype(np.int64), who.astype(np.int64) + at, n.astype(np.int64), node.reshape(-1, 2), part.reshape(-1, 2)))
        at += len(n)
    s, pos, who, n, node, part = (np.concatenate(c) for c in zip(*cols))
    label = np.unique(part.view([("a", U), ("b", U)]).reshape(-1), return_inverse=True)[1]
    order = np.lexsort((node[who, 0], n[who], s))
    s, pos, who = s[order], pos[order], who[order]
    first = np.append(np.flatnonzero(run_starts(s)), len(s))
    open_lists = [(a, z) for a, z in zip(first[:-1].tolist(), first[1:].tolist()) if z - a > 1 and (label[who[a:z]] != label[who[a]]).any()]
    return s, pos, who, n, node, label, open_lists


def _needed(a, b, similarity):
    """Smallest intersection of linked sets of these sizes."""
    return -(-similarity * (a + b) // (100 + similarity))


def _pairs(found: list[np.ndarray], node: np.ndarray) -> pa.Table:
    p = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    p = np.unique(p, axis=0) if len(p) else p
    raw = [[node[i].tobytes() for i in p[:, k].tolist()] for k in (0, 1)]
    flip = [x > y for x, y in zip(*raw)]
    a = [y if f else x for x, y, f in zip(*raw, flip)]
    b = [x if f else y for x, y, f in zip(*raw, flip)]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _first_pairs(similarity: int):
    """Each set of a list with a centre (the smallest set, then the smallest of those whose size no
    earlier centre can link), and with another set that its size can link, a different one in every
    list: sets of a loose family, which no centre links, meet several of its members that way."""

    def run(t: pa.Table) -> pa.Table:
        shingle, pos, who, n, node, label, lists = _lists(t)
        found = []
        for a, z in lists:
            w = who[a:z]
            size = n[w]  # ascending
            turn = int(mix(shingle[a : a + 1])[0] >> U(33))
            if len(w) > FAMILY:
                i = np.arange(len(w))
                low = np.searchsorted(size * 100, size * similarity)
                wide = np.searchsorted(size * similarity, size * 100, "right") - low
                j = low + (i - low + 1 + turn % np.maximum(wide - 1, 1)) % wide  # any but itself
                found.append(np.stack([w, w[j]], 1)[j != i])
            at = 0
            while len(w) - at > 1:
                near = at + int(np.searchsorted(size[at:] * similarity, size[at] * 100, "right"))
                other = w[at + 1 : near]
                if len(other):
                    found.append(np.stack([np.full(len(other), w[at]), other], 1))
                at = near
        return _pairs(found, node)

    return run


def _open_pairs(similarity: int):
    """The pairs of a list that are in different components and that size and position allow."""

    def run(t: pa.Table) -> pa.Table:
        shingle, pos, who, n, node, label, lists = _lists(t)
        found = []
        for a, z in lists:
            w = who[a:z]
            mark, size = label[w], n[w]
            left = size - pos[a:z]  # what can still agree, this shingle included
            blocks = np.maximum.reduceat(left, np.arange(0, z - a, SKIP))
            for i in range(z - a - 1):
                end = int(np.searchsorted(size * similarity, size[i] * 100, "right"))
                least = int(_needed(size[i], size[i], similarity))
                if left[i] < least:
                    continue
                for k in range((i + 1) // SKIP, -(-end // SKIP)):
                    if blocks[k] < least:
                        continue
                    j = np.arange(max(i + 1, k * SKIP), min(end, (k + 1) * SKIP))
                    j = j[(mark[j] != mark[i]) & (np.minimum(left[j], left[i]) >= _needed(size[i], size[j], similarity))]
                    if len(j):
                        found.append(np.stack([np.full(len(j), w[i]), w[j]], 1))
        return _pairs(found, node)

    return run


def _verified(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose sets reach the similarity; exact intersections."""

    def run(batches):
        for t in batches:
            na, nb, ra, rb = (t.column(t.schema.get_field_index(c)) for c in ("na", "nb", "ra", "rb"))
            keep = []
            for x, y, p, q in zip(na.to_pylist(), nb.to_pylist(), ra, rb):
                p, q = np.frombuffer(p.as_py(), U), np.frombuffer(q.as_py(), U)
                both = len(np.intersect1d(p, q, assume_unique=True)) if min(len(p), len(q)) >= _needed(x, y, similarity) else 0
                keep.append(100 * both >= similarity * (x + y - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = pairs.count()  # of a checkpoint
    if known <= FEW_PAIRS:  # 32 bytes each: only the classes in question are shuffled
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        classes = classes.join(F.broadcast(nodes), "node", "left_semi")
    side = lambda k: classes.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("rest").alias(f"r{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(B.task_gives_back(run), PAIRS)


def components(links: DataFrame) -> DataFrame:
    """(node, part) for every node of a link: part is the least node that it reaches.

    A round hangs a node's greater neighbours on its least neighbour, then its smaller ones, so that
    paths shrink geometrically; it ends when the edges stay as they are.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = _slim(edges).checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _slim(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()).checkpoint()
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        edges = small
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("part"))).distinct()
        state = now


def _slim(pairs: DataFrame) -> DataFrame:
    """Pairs and links are a small part of what the shuffle is sized for: fewer, fuller partitions."""
    return pairs.coalesce(max(1, B.parts(pairs.sparkSession) // 16))


def _pair_up(classes: DataFrame, links: DataFrame | None, fn, similarity: int) -> DataFrame:
    """Distinct pairs that ``fn`` finds in the index lists, given the links so far."""
    if links is None:
        known = classes.withColumn("part", F.col("node"))
    else:
        known = classes.join(components(links), "node", "left").withColumn("part", F.coalesce("part", "node"))
    return _slim(_postings(known, similarity).groupBy("bucket").applyInArrow(B.group_gives_back(fn(similarity)), PAIRS).distinct())


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every one of b."""
    both = a + b
    size, n = np.array([len(x) for x in both], np.int64), len(both)
    who = np.repeat(np.arange(n), size)
    names, col = np.unique(np.concatenate(both), return_inverse=True)
    centre = np.isin(names, a[0])
    count = np.bincount(col, minlength=len(names))
    agree = np.bincount(who, centre[col], n).astype(np.int64)
    gone = len(a[0]) - agree
    out = len(a[0]) - gone[: len(a), None] - gone[None, len(a) :]
    used = np.flatnonzero(np.where(centre, n - count, count) >= 2)
    at = np.full(len(names), -1)
    at[used] = np.arange(len(used))
    keep = at[col] >= 0
    who, col = who[keep], at[col[keep]]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    for start in range(0, len(used), COLUMNS):
        own = centre[used[start : start + COLUMNS]]
        x, z = np.searchsorted(col, [start, start + COLUMNS])
        d = np.repeat(own[None, :].astype(np.float32), n, 0)
        c = col[x:z] - start
        d[who[x:z], c] = ~own[c]
        out += (d[: len(a)] @ d[len(a) :].T).astype(np.int64)
    return out


def _linked(a, b, similarity: int) -> np.ndarray:
    """Which of the sets of two groups (sizes, shingles) link."""
    both, total = _shared(a[1], b[1]), a[0][:, None] + b[0][None, :]
    return 100 * both >= similarity * (total - both)


def _group_up(similarity: int):
    """Sets sorted by component and group: a group's links within itself, and itself packed if there are others."""

    def packed(key, rows) -> pa.RecordBatch:
        part, chunk, chunks = key
        node, n, rest = zip(*rows)
        names, n, sets = np.frombuffer(b"".join(node), U), np.array(n, np.int64), [np.frombuffer(x, U) for x in rest]
        links = _linked((n, sets), (n, sets), similarity)
        np.fill_diagonal(links, False)
        body = None
        if chunks > 1:
            distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
            body = B.dump(names, n, np.array([len(x) for x in sets], np.int64), distinct, at.astype(np.uint32), level=6)
        return B.table(PACKED, [(part, chunk, chunks, body, B.dump(names, links.sum(1)))]).to_batches()[0]

    def run(batches):
        key, held = None, []
        for b in batches:
            cols = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "chunk", "chunks", "node", "n_shingles", "rest"))
            for *now, node, n, rest in zip(*cols):
                if held and now != key:
                    yield packed(key, held)
                    held = []
                key = now
                held.append((node, n, rest))
        if held:
            yield packed(key, held)

    return run


def _between(similarity: int):
    """Links between two groups of a component."""

    def run(t: pa.Table) -> pa.Table:
        groups = []
        for x in t["body"]:
            names, n, size, distinct, at = B.load(x.as_py())
            groups.append((names, n, np.split(distinct[at], np.cumsum(size)[:-1])))
        if len(groups) < 2:  # the other group has no sets
            return B.table("counts binary", [])
        (names_a, *a), (names_b, *b) = groups
        links = _linked(a, b, similarity)
        return B.table("counts binary", [(B.dump(names_a, links.sum(1)),), (B.dump(names_b, links.sum(0)),)])

    return run


def _link_counts(classes: DataFrame, found: DataFrame, similarity: int) -> DataFrame:
    """(node, n_links) for every class of a component: how many other classes it links to."""
    parts = B.parts(classes.sparkSession)
    small = classes.select("node", "n_shingles").join(found, "node")
    size = small.groupBy("part").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n_shingles") / GROUP_ITEMS)).cast("int").alias("chunks"))
    place = small.join(size, "part").select("node", "part", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int").alias("chunk"), "chunks")
    dealt = classes.select("node", "n_shingles", "rest").join(place, "node").repartition(parts, "part", "chunk").sortWithinPartitions("part", "chunk")
    packed = dealt.mapInArrow(_group_up(similarity), PACKED).checkpoint()
    other = packed.where("chunks > 1").select("part", "chunk", "body", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).where("other <> chunk")
    pairs = other.select("part", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "body")
    counts = packed.select("counts").unionByName(pairs.groupBy("part", "lo", "hi").applyInArrow(_between(similarity), "counts binary"))

    def rows(batches):
        for b in batches:
            for x in b.column(0):
                names, n = B.load(x.as_py())
                yield from B.table("node binary, n long", [(x.tobytes(), k) for x, k in zip(names.reshape(-1, 2), n.tolist())]).to_batches()

    return counts.mapInArrow(rows, "node binary, n long").groupBy("node").agg(F.sum("n").alias("n_links"))


def _joined(blocks: DataFrame, width: int, similarity: int, id_col: str, text_col: str, counted: bool = False) -> DataFrame:
    """(block, row, doc_id, n_shingles, node, part, component_id) of every row, and n_links if ``counted``."""
    rows = _rows(blocks, width, similarity, id_col, text_col).checkpoint()
    classes = rows.where("rest is not null").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("alone").alias("alone"), F.first("rest").alias("rest")).checkpoint()
    tried = _pair_up(classes, None, _first_pairs, similarity).checkpoint()
    links = _verified(tried, classes, similarity).checkpoint()
    rest = _pair_up(classes, links, _open_pairs, similarity).join(tried, ["a", "b"], "left_anti").checkpoint()
    links = links.unionByName(_verified(rest, classes, similarity))
    # the smallest number of a component: first by set (copies), then by component
    by_set = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    found = components(links)
    by_set = by_set.join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    by_part = by_set.groupBy("part").agg(F.min("first_id").alias("component_id"))
    ids = by_set.join(by_part, "part").select("node", "part", "component_id")
    if counted:
        ids = ids.join(_link_counts(classes, found, similarity), "node", "left")
    out = rows.drop("alone", "rest").join(ids, "node", "left")
    if counted:
        out = out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and node (the set's 128-bit name) of every document."""
    blocks = B.pack(B.chosen(docs, id_col, text_col), text_col)
    return _joined(blocks, width, similarity, id_col, text_col).select("doc_id", "n_shingles", "component_id", "node")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """``joined`` and n_links, the number of other classes (nodes) that the document's own links to."""
    blocks = B.pack(B.chosen(docs, id_col, text_col), text_col)
    return _joined(blocks, width, similarity, id_col, text_col, True).select("doc_id", "n_shingles", "component_id", "node", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: int = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest number (of rows
    that share it, the first read).  Rows without a set all stay."""
    blocks = B.pack(docs, text_col)
    found = _joined(blocks, width, similarity, id_col, text_col)
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "block", "row")
    kept = found.where("part is not null").groupBy("part").agg(F.min(place).alias("x")).select("x.block", "x.row")
    kept = kept.unionByName(found.where("part is null").select("block", "row"))

    def keep(block, t, rows):
        return t.take(rows["row"].sort()) if rows.num_rows else t.slice(0, 0)

    return B.with_answers(blocks, kept, keep, docs.schema)
