"""Joins by similarity without comparing all pairs, and the groups they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint



def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(a, b) -> (node, root): smallest node of each component, by large-star and small-star rounds in tables.

    `nodes` (node) adds single nodes. A hub is only ever the stream side of a join, and each round is written to the checkpoint folder.
    """
    links, before = checkpoint(edges.toDF("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpoint(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    found = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    if nodes is None:
        return found
    return nodes.toDF("node").distinct().join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a, b):
    """Similarity 0 to 1 of two texts: 2 * longest common subsequence / both lengths, by bit-parallel rows."""
    import pandas as pd

    def lcs(x: str, y: str) -> int:
        where: dict[str, int] = {}
        for i, c in enumerate(x):
            where[c] = where.get(c, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            hit = row & where.get(c, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([1.0 if not x and not y else 2.0 * lcs(x, y) / (len(x) + len(y)) for x, y in zip(a, b)])


def window_pairs(rows: DataFrame, window: int, threshold: float) -> DataFrame:
    """(at, key) with consecutive positions -> pairs (a, b) of rows at most `window` apart whose keys are at least `threshold` alike.

    Positions are exploded, so it is an equi-join; an edit-distance bound that loses nothing (edits never exceed indels) spares most pairs
    the exact ratio. Each row meets `window` others, whatever the data.
    """
    t = rows.where("key <> ''")
    left = t.select(F.col("at").alias("a"), F.col("key").alias("ka"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + window)).alias("b"))
    pairs = left.join(t.select(F.col("at").alias("b"), F.col("key").alias("kb")), "b")
    pairs = pairs.where(f"levenshtein(ka, kb, cast(floor((1 - {threshold}) * (length(ka) + length(kb))) as int)) >= 0")
    return pairs.where(indel_ratio("ka", "kb") >= threshold).select("a", "b")


def hamming_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(id, bits) of 64-bit hashes -> (a, b, distance) for distinct hashes at most `most` bits apart, each hash once (see members).

    most + 1 bands of bits: two hashes so near agree in one band at least, so bands are equi-joined; bands are tried in order and a pair
    is kept by the first band it agrees in.
    """
    bands, t = most + 1, rows.select(F.col("bits").cast("long").alias("bits")).distinct()
    edge = [64 * i // bands for i in range(bands + 1)]
    part = lambda c, i: F.expr(f"shiftrightunsigned({c}, {edge[i]}) & {(1 << (edge[i + 1] - edge[i])) - 1}")
    keyed = t.select("bits", F.posexplode(F.array(*[part("bits", i) for i in range(bands)])).alias("band", "value"))
    a, b = keyed.withColumnRenamed("bits", "a"), keyed.withColumnRenamed("bits", "b")
    pairs = a.join(b, ["band", "value"]).where("a < b").withColumn("distance", F.expr("bit_count(a ^ b)")).where(F.col("distance") <= most)
    first = F.expr("case " + " ".join(f"when ({_band('a', edge, i)}) = ({_band('b', edge, i)}) then {i}" for i in range(bands)) + " end")
    return pairs.where(F.col("band") == first).select("a", "b", "distance")


def _band(c: str, edge: list[int], i: int) -> str:
    return f"shiftrightunsigned({c}, {edge[i]}) & {(1 << (edge[i + 1] - edge[i])) - 1}"


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(w, n) -> (w, n, other, m): pairs of words one edit apart of which other is rarer.

    Words meet at the forms that come of dropping one letter (or none): two words one edit apart share such a form.
    """
    drop = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w"))))
    keyed = vocabulary.select("w", "n", F.explode(F.array_distinct(F.concat(F.array("w"), drop))).alias("k"))
    a, b = keyed, keyed.select(F.col("w").alias("other"), F.col("n").alias("m"), "k")
    return a.join(b, "k").where("w <> other and m < n").select("w", "n", "other", "m").distinct().where(F.levenshtein("w", "other", 1) == 1)


#: Texts and characters of a block; buckets of characters and of pairs of characters; counts that a first look at two texts compares.
BLOCK, BLOCK_CHARS, CHARS, BIGRAMS, COLUMNS = 20_000, 16_000_000, 96, 256, 128
#: Blocks from which on those of alike_pairs grow, up to so many times BLOCK: every text is sent to each block. Rows and columns compared at once.
SPREAD, WIDER, TILE = 8, 4, (32, 4_096)
#: Texts that one meets at once in _best_partners, at most so many words of their bits, and counts that a bound by characters compares.
BATCH, BATCH_WORDS, LEVELS = 4_096, 8_000_000, 192


def _bags(texts: list[str]):
    """Counts of characters and of neighbouring characters by buckets, 255 at most: a row a text."""
    import numpy as np

    if len(texts) > (some := 8_000):  # the counts are wide before they are cut
        return tuple(np.concatenate(x) for x in zip(*(_bags(texts[i : i + some]) for i in range(0, len(texts), some))))
    size = np.array([len(x) for x in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.arange(len(texts)), size)
    bag = lambda of, k, n: np.minimum(np.bincount(of * n + k, minlength=len(texts) * n), 255).astype(np.uint8).reshape(len(texts), n)
    inside = of[1:] == of[:-1]
    mixed = (code[:-1] * np.uint32(0x9E3779B1) + code[1:] * np.uint32(0x85EBCA77)) >> np.uint32(24)
    return size, bag(of, code % CHARS, CHARS), bag(of[:-1][inside], mixed[inside].astype(np.int64) % BIGRAMS, BIGRAMS)


def _near_bags(left: list[str], right: list[str] | None, share: float):
    """Arrays of places (i, j) of texts that may be alike by their bags, in parts: at most share * (|a| + |b|) indels; right None: pairs inside left.

    An indel changes one count of the characters and at most three of the neighbouring ones, so distances between bags lose no pair, in any
    buckets and columns. The first is between bits, whether a count is k or more, of the columns that tell most.
    """
    import numpy as np

    own = right is None
    order = lambda t: sorted(range(len(t)), key=lambda i: len(t[i]))
    ia = np.array(order(left), np.int64)
    na, ca, ga = _bags([left[i] for i in ia])
    ib, (nb, cb, gb) = (ia, (na, ca, ga)) if own else ((o := np.array(order(right), np.int64)), _bags([right[i] for i in o]))
    some = np.concatenate([c[:: max(1, len(c) // 2_000)] for c in (ca, cb)])
    levels = [(c, k, p * (1 - p)) for c in range(CHARS) for k in range(1, min(int(some[:, c].max()), 64) + 1) for p in [(some[:, c] >= k).mean()]]
    best = sorted(levels, key=lambda x: -x[2])[:COLUMNS]
    at, least = np.array([x[0] for x in best], int), np.array([x[1] for x in best], int)

    def bits(c):
        """Words of 64 columns: a row a word."""
        x = np.zeros((len(c), COLUMNS), bool)
        x[:, : len(best)] = c[:, at] >= least
        return np.packbits(x, axis=1).view(np.uint64).T.copy()

    xa, xb = bits(ca), bits(cb)

    def first():
        rows, cols = TILE
        for at_row in range(0, len(na), rows):
            end = min(at_row + rows, len(na))
            lo = max(np.searchsorted(nb, na[at_row] * (1 - share) / (1 + share) - 1), at_row if own else 0)
            hi = np.searchsorted(nb, na[end - 1] * (1 + share) / (1 - share) + 1)
            for col in range(lo, hi, cols):
                stop = min(col + cols, hi)
                most = np.minimum(share * (na[end - 1] + nb[col:stop]) + 1e-6, 255).astype(np.uint8)
                apart = np.zeros((end - at_row, stop - col), np.uint8)
                for wa, wb in zip(xa, xb):
                    apart += np.bitwise_count(wa[at_row:end, None] ^ wb[None, col:stop])
                i, j = np.divmod(np.flatnonzero(apart <= most), stop - col)
                i, j = i + at_row, j + col
                yield (i[i < j], j[i < j]) if own else (i, j)

    def second(p, q):
        for a, b, each in ((ca, cb, 1), (ga, gb, 3)):
            most = each * share * (na[p] + nb[q]) + 1e-6
            keep = (np.abs(a[p].astype(np.int16) - b[q]).sum(1) <= most) & (np.abs(na[p] - nb[q]) <= most)
            p, q = p[keep], q[keep]
        return ia[p], ib[q]

    held, n = [], 0
    for i, j in first():
        held.append((i, j))
        n += len(i)
        if n >= 20_000:
            yield second(*map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield second(*map(np.concatenate, zip(*held)))


def blocks(texts: DataFrame, text: str, spread: int | None = None) -> int:
    """Number of blocks for a table of texts, by their number and their characters. spread: as many blocks are enough, if none gets too wide."""
    n, chars = texts.agg(F.count("*"), F.sum(F.length(text))).first()
    by_number = -(-n // BLOCK)
    return max(1, by_number if spread is None else max(min(by_number, spread), -(-n // (WIDER * BLOCK))), -(-(chars or 0) // BLOCK_CHARS))


def _two_blocks(t: DataFrame, n: int):
    """Rows with a text in n blocks, grouped by every two of these: pair is divisible by n + 1 where both are one block, first tells the sides."""
    kept, other = t.columns, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    both = t.select(*kept, F.pmod(F.xxhash64("text"), F.lit(n)).cast("int").alias("at"), other)
    both = both.select(*kept, F.expr(f"least(at, other) * {n}L + greatest(at, other)").alias("pair"), (F.col("at") <= F.col("other")).alias("first"))
    parts = max(n * (n + 1), min(5 * n * (n + 1), 240))  # few groups would often share a task
    return both.repartition(parts, "pair").groupBy("pair")


def alike_pairs(texts: DataFrame, percent: int, key: str | None = None) -> DataFrame:
    """Distinct (text) -> (a, b, ratio), a < b, of texts with an indel ratio of at least percent / 100.

    Exact. Texts go into blocks by a hash, and every two blocks meet in one group, where bits tell which pairs may be alike by their bags of
    characters (see _near_bags); only these become rows. So the rows are those of the result and a few more, whatever the texts share; the work
    in the groups still grows with the square of the number of texts, a text being sent to each block once.

    key: a column of longs; pairs have the smallest of each text beside them (key_a, key_b), so nothing is joined to the texts again.
    """
    t, keys = texts.where(F.length("text") > 0), ["key"] if key else []
    t = checkpoint(t.groupBy("text").agg(F.min(key).alias("key")) if key else t.select("text").distinct())
    n, share = blocks(t, "text", SPREAD), (100 - percent) / 100

    def meet(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        own = group["pair"][0].as_py() % (n + 1) == 0
        left = group.filter(group["first"])
        right = left if own else group.filter(pc.invert(group["first"]))
        lists = left["text"].to_pylist(), None if own else right["text"].to_pylist()
        near = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *_near_bags(*lists, share)]
        i, j = (pa.array(np.concatenate(x)) for x in zip(*near))
        a, b = left.take(i), right.take(j)
        return pa.table({"a": a["text"], "b": b["text"]} | ({"key_a": a["key"], "key_b": b["key"]} if key else {}))

    schema = "a string, b string" + ", key_a long, key_b long" * bool(key)
    pairs = _two_blocks(t, n).applyInArrow(meet, schema)
    low = F.col("a") < F.col("b")
    sides = [F.when(low, F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("key_a", "key_b"), ("key_b", "key_a")) if key]
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *sides)
    near = f"levenshtein(a, b, cast(floor({100 - percent} * (length(a) + length(b)) / 100.0 + 1e-9) as int)) >= 0"
    return pairs.where(near).withColumn("ratio", indel_ratio("a", "b")).where(F.col("ratio") >= percent / 100 - 1e-12)


def _best_partners(texts: list[str], cut: int | None, known=None, tries: int | None = None):
    """For each of these distinct texts the most alike other one by indel ratio, of several the first: arrays (ratio, place), -1 if there is none.

    cut: pairs have one text of the first `cut` and one of the others; None: all pairs. known: ratios that the texts reach, here or elsewhere;
    partners below may be missing. tries: only so many texts that are nearest by bags are compared with each.

    The characters that two texts don't share are indels. So are those of the first and the second half of a text beyond what the other one has
    before and after the best place for a cut; places are looked at by fours, and one in two off costs two on either side.
    """
    import numpy as np

    n, size = len(texts), np.array([len(x) for x in texts], np.int64)
    held, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    start, mask, top, last = np.cumsum(size) - size, np.uint64(2**63 - 1), np.uint64(63), 2**62
    best, other = np.full(n, -1.0), np.full(n, last)
    known = best if known is None else np.array(known, float)
    of = np.repeat(np.arange(n), size)
    late = (np.arange(len(of)) - start[of] >= (size // 2)[of]).astype(np.int64)
    bucket = (held[code] % CHARS).astype(np.int64)
    halves = np.bincount((late * n + of) * CHARS + bucket, minlength=2 * n * CHARS).reshape(2, n, CHARS)

    def columns(c):
        some = c[:: max(1, len(c) // 2_000)]
        levels = [(k, x, p * (1 - p)) for k in range(CHARS) for x in range(1, min(int(some[:, k].max(initial=0)), 64) + 1) for p in [(some[:, k] >= x).mean()]]
        kept = sorted(levels, key=lambda x: -x[2])[:LEVELS]
        return np.array([x[0] for x in kept], int), np.array([x[1] for x in kept], int)

    def bits(c, cols):
        """Whether counts are so many or more, in words: a row a word."""
        x = np.zeros((len(c), LEVELS), bool)
        x[:, : len(cols[0])] = c[:, cols[0]] >= cols[1]
        return np.packbits(x, axis=1).view(np.uint64).T.copy()

    whole, cols = halves.sum(0), [columns(x) for x in halves]
    full = bits(whole, columns(whole))
    early, after = (bits(x, y) for x, y in zip(halves, cols))
    asked = np.argsort(size[:cut], kind="stable")
    place = np.full(n, -1)
    place[asked] = np.arange(len(asked))
    places: dict[int, tuple] = {}

    def cuts(b):
        """Bits of what stands before and after every fourth place of a text."""
        if b not in places:
            each = np.zeros((int(size[b]) + 1, CHARS), np.int32)
            each[np.arange(1, len(each)), bucket[start[b] : start[b] + size[b]]] = 1
            before = np.cumsum(each, 0)[::4]
            places[b] = bits(before, cols[0]), bits(whole[b] - before, cols[1])
        return places[b]

    def common(a, b):
        """Lengths of common subsequences of texts of the batch, by their places in it, with others: the rows of many pairs go on together."""
        row, alive, m, there = np.full((words, len(a)), mask), len(a), len(part), places_of_hits
        for step in range(int(size[b].max(initial=0))):
            alive = int(np.searchsorted(-size[b[:alive]], -step, side="left"))
            at_hit = there[start[b[:alive]] + step] + a[:alive]
            for w in range(words):
                r = row[w, :alive]
                u = r & hits.take(at_hit + w * m)
                t = r + u
                if w:
                    t += carry  # noqa: F821
                r -= u
                r |= t
                if w < words - 1:
                    carry = t >> top  # noqa: F841
                    r &= mask
        return 63 * words - np.bitwise_count(row & mask).sum(0, dtype=np.int64)

    def compare(pairs):
        a, b = (np.concatenate(x) for x in zip(*pairs))
        order = np.argsort(-size[b], kind="stable")
        a, b = a[order], b[order]
        i = part[a]
        ratio = 2.0 * common(a, b) / (size[i] + size[b])
        keep = (ratio >= np.maximum(best[i], known[i])) | (ratio >= np.maximum(best[b], known[b]))
        i, b, ratio = i[keep], b[keep], ratio[keep]
        x, y, r = np.concatenate([i, b]), np.concatenate([b, i]), np.concatenate([ratio, ratio])
        order = np.lexsort((y, -r, x))
        x, y, r = x[order], y[order], r[order]
        head = np.flatnonzero(np.diff(x, prepend=-1))
        x, y, r = x[head], y[head], r[head]
        better = (r > best[x]) | ((r == best[x]) & (y < other[x]))
        best[x[better]], other[x[better]] = r[better], y[better]

    rows, at = np.arange(cut or 0, n), 0
    while at < len(asked):
        words = max(1, -(-int(size[asked[min(at + BATCH, len(asked)) - 1]]) // 63))
        part = asked[at : at + max(64, min(BATCH, BATCH_WORDS // (words * (len(held) + 1))))]
        mine, sizes = np.repeat(np.arange(len(part)), size[part]), size[part]
        inside = np.arange(len(mine)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hits = np.zeros((len(held), words, len(part)), np.uint64)
        np.add.at(hits, (code[start[part][mine] + inside], inside // 63, mine), np.uint64(1) << (inside % 63).astype(np.uint64))
        places_of_hits = code * (words * len(part))
        hits, pa, ea, la = hits.ravel(), full[:, part], early[:, part], after[:, part]
        reach, pairs, waiting = np.maximum(best, known)[part], [], 0
        low, who = np.full(len(part), np.inf), np.full(len(part), -1)
        for b in rows.tolist():
            if cut is None and place[b] < at:
                continue
            lo = int(place[b]) - at + 1 if cut is None and place[b] < at + len(part) else 0
            if lo == len(part):
                continue
            apart = np.bitwise_count(pa[0, lo:] ^ full[0, b])
            for w in range(1, len(pa)):
                apart += np.bitwise_count(pa[w, lo:] ^ full[w, b])
            both = sizes[lo:] + size[b]
            if tries is not None:
                score = apart / both
                nearer = score < low[lo:]
                low[lo:][nearer], who[lo:][nearer] = score[nearer], b
                some = np.argpartition(score, tries)[:tries] if len(score) > tries else np.arange(len(score))
            else:
                most = (1 - np.minimum(reach[lo:], max(best[b], known[b]))) * both + 1e-6
                some = np.flatnonzero(apart <= most)
                if len(some) > 16:
                    before, behind = cuts(b)
                    half = most[some].max() / 2 + 4
                    f, t = max(0, int((size[b] / 2 - half) // 4)), int((size[b] / 2 + half) // 4) + 2
                    least = np.zeros((before[:, f:t].shape[1], len(some)), np.uint16)
                    for x, y in ((ea, before), (la, behind)):
                        for w in range(len(x)):
                            least += np.bitwise_count(x[w, lo:][some][None] ^ y[w, f:t][:, None])
                    some = some[least.min(0) <= most[some] + 4]
            if len(some):
                pairs.append((some + lo, np.full(len(some), b)))
                waiting += len(some)
            if waiting >= 8_192:
                compare(pairs)
                reach, pairs, waiting = np.maximum(best, known)[part], [], 0
        if (seen := np.flatnonzero(who >= 0)).size:
            pairs.append((seen, who[seen]))
        if pairs:
            compare(pairs)
        at += len(part)
    return best, np.where(best < 0, -1, other)


def nearest_texts(texts: DataFrame) -> DataFrame:
    """Distinct (text, key, id) -> (id, other, ratio): of all other texts the one with the highest indel ratio, of several that of the least key and id.

    Exact, whatever the ratio: texts go into blocks by a hash, and every two blocks meet in one group. First a few texts a block are compared with
    each, for a ratio that holds over all blocks, then all that may be as near by their characters. The work still grows with the square of the
    number of texts.
    """
    t = checkpoint(texts.select("text", F.col("key").cast("long").alias("key"), "id").where("text is not null"))
    n = max(blocks(t, "text", SPREAD), min(SPREAD, -(-t.count() // BATCH)))

    def meet(tries):
        def run(group):
            import numpy as np
            import pyarrow as pa

            own = group["pair"][0].as_py() % (n + 1) == 0
            key, name, first = (group[c].to_pylist() for c in ("key", "id", "first"))
            order = sorted(range(len(key)), key=lambda i: (not first[i], key[i] is not None, key[i] or 0, name[i]))
            group = group.take(pa.array(order, pa.int64()))
            known = np.array(group["known"].to_pylist())
            ratio, other = _best_partners(group["text"].to_pylist(), None if own else sum(first), known, tries)
            there = (other >= 0) & (ratio >= known)
            found = group.take(pa.array(other[there]))
            return pa.table({"id": group.filter(pa.array(there))["id"], "key": found["key"], "other": found["id"], "ratio": pa.array(ratio[there])})

        return run

    schema = "id string, key long, other string, ratio double"
    some = _two_blocks(t.withColumn("known", F.lit(-1.0)), n).applyInArrow(meet(8), schema)
    some = checkpoint(some.groupBy("id").agg(F.max("ratio").alias("known")))
    t = t.join(some.hint("merge"), "id", "left").withColumn("known", F.coalesce("known", F.lit(-1.0)))
    found = _two_blocks(t, n).applyInArrow(meet(None), schema)
    found = found.groupBy("id").agg(F.min(F.struct((-F.col("ratio")).alias("less"), "key", "other")).alias("x"))
    return found.select("id", F.col("x.other").alias("other"), (-F.col("x.less")).alias("ratio"))


def _edits(where: dict[str, int], size: int, b: str) -> int:
    """Edit distance of b to a text of this size, whose places by character are the bits of `where`: a row of the table is two whole numbers."""
    if not size:
        return len(b)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    for c in b:
        hit = where.get(c, 0)
        x, y = hit | down, (((hit & up) + up) ^ up) | hit
        rise, fall = down | (full & ~(y | up)), up & y
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1) | 1
        up, down = ((fall << 1) | (full & ~(x | rise))) & full, rise & x & full
    return score


def _edits_to_many(where: dict[str, int], size: int, places: dict[str, int], codes, lengths):
    """_edits to many texts at once, in words of 64 bits: rows of `codes` (places of characters in `places`), the longest first."""
    import numpy as np

    words, one = -(-size // 64), np.uint64(1)
    table = np.zeros((words, len(places) + 1), np.uint64)
    for c, bits in where.items():
        if c in places:
            table[:, places[c]] = [(bits >> (64 * w)) & (2**64 - 1) for w in range(words)]
    up, down = np.full((words, len(codes)), 2**64 - 1, np.uint64), np.zeros((words, len(codes)), np.uint64)
    score, alive = np.full(len(codes), size, np.int64), len(codes)
    for step in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-lengths[:alive], -step, side="left"))
        plus, minus = one, np.uint64(0)
        for w in range(words):
            hit, u, d = table[w][codes[:alive, step]], up[w, :alive], down[w, :alive]
            x = hit | d
            hit |= minus
            y = (((hit & u) + u) ^ u) | hit
            rise, fall = d | ~(y | u), u & y
            top = np.uint64((size - 1) % 64 if w == words - 1 else 63)
            out = (rise >> top) & one, (fall >> top) & one
            rise, fall = (rise << one) | plus, (fall << one) | minus
            up[w, :alive], down[w, :alive] = fall | ~(x | rise), rise & x
            plus, minus = out
        score[:alive] += plus.astype(np.int64) - minus.astype(np.int64)
    return score


def _least_edits(queries: list[str], bounds: list[int], texts: list[str], tries: int | None):
    """Smallest edit distance of each query to the texts, where it is at most its bound, else None. `tries`: only so many texts are compared.

    An edit changes two counts of characters at most, and four of neighbouring ones. Texts are compared by the bound that follows, least first,
    until none can be nearer than the best.
    """
    import numpy as np

    (na, ca, ga), (nb, cb, gb) = _bags(queries), _bags(texts)
    each = cb[:: max(1, len(cb) // 2_000)]
    levels = [(c, k, p * (1 - p)) for c in range(CHARS) for k in range(1, min(int(each[:, c].max(initial=0)), 64) + 1) for p in [(each[:, c] >= k).mean()]]
    kept = sorted(levels, key=lambda x: -x[2])[:COLUMNS]
    at, least = np.array([x[0] for x in kept], int), np.array([x[1] for x in kept], int)
    xb = (cb[:, at] >= least).astype(np.float32)
    rb = xb.sum(1)
    held, code = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    places, start = {chr(c): k for k, c in enumerate(held)}, np.cumsum(nb) - nb

    def many(where, size, of):
        of = of[np.argsort(-nb[of], kind="stable")]
        of = of[nb[of] > 0] if size else of[:0]
        inside = np.arange(int(nb[of].max(initial=0)))[None]
        codes = code[np.minimum(start[of][:, None] + inside, max(len(code) - 1, 0))] if len(of) else np.zeros((0, 0), int)
        return int(_edits_to_many(where, size, places, codes, nb[of]).min(initial=bound + 1))

    for i, (text, bound) in enumerate(zip(queries, bounds)):
        xa = (ca[i, at] >= least).astype(np.float32)
        low = (xa.sum() + rb - 2 * (xb @ xa) + np.abs(nb - na[i])) / 2
        near = np.flatnonzero(low <= bound + 0.01)
        if tries is not None and len(near) > 8 * tries:
            near = near[np.argpartition(low[near], 8 * tries)[: 8 * tries]]
        low = low[near] - 0.01
        if len(near) <= 2_000:
            low = np.maximum((np.abs(cb[near].astype(np.int16) - ca[i]).sum(1) + np.abs(nb[near] - na[i])) / 2, np.abs(gb[near].astype(np.int16) - ga[i]).sum(1) / 4)
        where: dict[str, int] = {}
        for j, c in enumerate(text):
            where[c] = where.get(c, 0) | (1 << j)
        best, order = bound + 1, np.argsort(low, kind="stable")[:tries]
        for j in order[:16]:
            if low[j] < best:
                best = min(best, _edits(where, len(text), texts[near[j]]))
        for part in range(16, len(order), 4_096):
            some = order[part : part + 4_096]
            some = some[low[some] < best]
            if not len(some):
                break
            best = min(best, many(where, len(text), near[some]))
        yield best if best <= bound else None


def _nearest_by_bags(queries: DataFrame, texts: DataFrame, n: int, tries: int | None) -> DataFrame:
    """(text, bound, most), texts (other) in n blocks -> (text, bound, best) of every block of queries and block of texts, at most `most`."""
    m = blocks(queries, "text")
    each = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    at = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    q = queries.select("text", "bound", "most", at("text", m).alias("x"), each(n, "y"))
    t = texts.select(F.col("other").alias("text"), F.lit(None).cast("int").alias("bound"), F.lit(None).cast("int").alias("most"), each(m, "x"), at("other", n).alias("y"))
    both = q.unionByName(t).select("text", "bound", "most", F.expr(f"x * {n}L + y").alias("pair"))

    def meet(group):
        import pyarrow as pa
        import pyarrow.compute as pc

        asked, held = group.filter(pc.is_valid(group["bound"])), group.filter(pc.is_null(group["bound"]))["text"].to_pylist()
        best = _least_edits(asked["text"].to_pylist(), asked["most"].to_pylist(), held, tries) if asked.num_rows and held else [None] * asked.num_rows
        out = pa.table({"text": asked["text"], "bound": asked["bound"], "best": pa.array(list(best), pa.int32())})
        return out.filter(pc.is_valid(out["best"]))

    return both.repartition(2 * m * n, "pair").groupBy("pair").applyInArrow(meet, "text string, bound int, best int")


def nearest_edits(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, bound) against (text) -> (text, bound, best): the smallest edit distance to any of the texts, where it is at most bound.

    Exact. k edits spoil at most k of a query's disjoint chunks of 8 characters, so of k + 1 one stands whole in the text, at most k characters
    off; which chunks are taken (rare ones, by a sample of the texts) changes speed only. Queries too short for their bound meet all texts in
    groups of two blocks, by their bags: first a few texts a block for a bound that holds over all blocks, then all that may be nearer.
    Joins are merges: Catalyst takes the places of chunks, some eighty a text, for as large as the texts' file and would send them over the driver.
    """
    q = checkpoint(queries.select("text", F.col("bound").cast("int").alias("bound")).where("bound >= 0 and text is not null").distinct().withColumn("len", F.length("text")))
    t = checkpoint(texts.select(F.col("text").alias("other")).where("other is not null").distinct())
    grams = F.expr("transform(sequence(0, length(other) - 8), i -> struct(xxhash64(substring(other, i + 1, 8)) as g, i as at))")
    long = t.where("length(other) >= 8")
    every = long.select(F.xxhash64("other").alias("of"), F.length("other").alias("size"), F.inline(grams))
    often = long.where("pmod(xxhash64(other), 16) = 0").select(F.inline(grams)).groupBy("g").agg(F.count("*").alias("f"))
    chunks = F.expr("transform(sequence(0, len div 8 - 1), i -> struct(xxhash64(substring(text, i * 8 + 1, 8)) as g, i * 8 as at))")
    own = q.where("len >= 8L * (bound + 1L)").select("text", "bound", "len", F.inline(chunks)).withColumnRenamed("at", "pa").join(often.hint("merge"), "g", "left")
    w = Window.partitionBy("text", "bound").orderBy(F.coalesce("f", F.lit(0)), "g", "pa")
    keys = own.withColumn("r", F.row_number().over(w)).where("r <= bound + 1").select("text", "bound", "len", "g", "pa")
    pairs = keys.join(every.hint("merge"), "g").where("abs(len - size) <= bound and abs(pa - at) <= bound").select("text", "bound", "of").distinct()
    pairs = pairs.join(t.withColumn("of", F.xxhash64("other")).hint("merge"), "of").withColumn("best", F.expr("levenshtein(text, other, bound)")).where("best >= 0")
    near = pairs.groupBy("text", "bound").agg(F.min("best").alias("best"))
    wide, n = q.where("len < 8L * (bound + 1L)").select("text", "bound"), blocks(t, "other")
    least = lambda d: d.groupBy("text", "bound").agg(F.min("best").alias("best"))
    first = checkpoint(least(_nearest_by_bags(wide.withColumn("most", F.col("bound")), t, n, 4)))
    rest = wide.join(first.hint("merge"), ["text", "bound"], "left").select("text", "bound", F.coalesce(F.col("best") - 1, "bound").alias("most"))
    nearer = _nearest_by_bags(rest.where("most >= 0"), t, n, None)
    return near.unionByName(least(first.unionByName(nearer)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """(id, v) of queries against (id, v) of vectors -> (id, other, place, value): the k nearest others, exactly, ties by id.

    A stated query set against all rows: queries go to the tasks in blocks of bounded size; each task keeps k per query of its own vectors, and
    only those are shuffled. value is the cosine, or the Euclidean distance.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    schema = "id long, other long, value double"
    out = spark.createDataFrame([], schema)
    clean = lambda d: d.where("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    vectors = clean(vectors)
    held: list = []

    def search(rows: list):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))

        def run(frames):
            ids, q = shared.value
            if metric == "cosine":
                q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
            best_v, best_i = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for f in frames:
                if not len(f):
                    continue
                x, other = np.array(f["v"].tolist(), float), f["id"].to_numpy()
                if metric == "cosine":
                    cost = -np.round(q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T, 9)
                else:
                    cost = np.round(np.sqrt(np.maximum(((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T), 0)), 9)
                cost = np.where(ids[:, None] == other[None], np.inf, cost)
                v, i = np.hstack([best_v, cost]), np.hstack([best_i, np.broadcast_to(other, cost.shape)])
                order = np.lexsort((i, v), axis=1)[:, :k]
                best_v, best_i = np.take_along_axis(v, order, 1), np.take_along_axis(i, order, 1)
            row, col = np.nonzero(np.isfinite(best_v))
            value = best_v[row, col]
            yield pd.DataFrame({"id": ids[row], "other": best_i[row, col], "value": -value if metric == "cosine" else value})

        return vectors.mapInPandas(run, schema)

    for r in clean(queries).toLocalIterator():
        held.append((r[0], list(r[1])))
        if len(held) == block:
            out, held = out.unionByName(search(held)), []
    if held:
        out = out.unionByName(search(held))
    order = F.desc("value") if metric == "cosine" else F.asc("value")
    w = Window.partitionBy("id").orderBy(order, "other")
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("id", "other", F.col("place").cast("int").alias("place"), "value")
