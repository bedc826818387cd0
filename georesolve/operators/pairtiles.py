"""Pairs of places with many listings: dealt in pairs of tiles, each measured by numpy in a group of its own.

The rules are those of ``resolution``. A tile has listings of one place and one bucket of areas; a pair of listings meets in
one pair of tiles only. Memory is bounded by the tile, not by what the pairs come to: rows leave in batches of a block.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listings of a tile, compared pairs of a block, text pairs of a tile that are counted at once.
TILE, BLOCK, TEXTS = 8192, 1 << 18, 1 << 22
ALL, LINKS, NEAR, STARS = "all", "links", "near", "stars"
UNKNOWN = np.iinfo(np.int64).max


def tile_pairs(rows: DataFrame, tile: int | None = None) -> DataFrame:
    """rows (k, place, bucket, ...) dealt to the pairs of tiles they are of: place, lo, hi, low (of lo, not of hi).

    Buckets meet those up to two away, null meets null. Pairs of tiles are few beside the rows, so only they are
    joined to each other.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    cell = F.struct(F.col("bucket").isNull().alias("none"), F.coalesce("bucket", F.lit(0).cast("bigint")).alias("at"))
    rows = rows.withColumn("cell", cell).drop("bucket")
    sizes = rows.groupBy("place", "cell").agg(F.ceil(F.count("*") / (tile or TILE)).cast("int").alias("parts"))
    of = lambda cell, parts: F.explode(F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda p: F.struct(cell["none"].alias("none"), cell["at"].alias("at"), p.alias("part"))))
    around = F.when(F.col("cell.none"), F.array("cell")).otherwise(F.transform(F.sequence(F.col("cell.at") - 2, F.col("cell.at") + 2), lambda at: F.struct(F.lit(False).alias("none"), at.alias("at"))))
    met = sizes.withColumn("near", F.explode(around)).join(sizes.select("place", F.col("cell").alias("near"), F.col("parts").alias("others")).hint("merge"), ["place", "near"])
    met = met.select("place", of(F.col("cell"), "parts").alias("own"), "near", "others").select("place", "own", of(F.col("near"), "others").alias("other"))
    own = F.struct(F.col("cell.none").alias("none"), F.col("cell.at").alias("at"), F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("part"))
    dealt = rows.join(sizes.hint("merge"), ["place", "cell"]).withColumn("own", own).drop("cell", "parts").join(met.hint("merge"), ["place", "own"])
    dealt = dealt.select("*", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).withColumn("low", F.col("own") == F.col("lo")).drop("own", "other")
    return dealt.repartition(n, "place", "lo", "hi")


def measured(rows: DataFrame, keep: str, rules: dict) -> DataFrame:
    """a, b (a < b) and their measures, of the pairs that ``keep`` asks for; of STARS only a, b.

    rows: k, place, bucket, code, named, area_m2, rooms, land_m2, price, photos (array of p, d: hashes as numbers), text (slug),
    apart (null, or keys it is not to be compared with). ALL: matching attributes or near photos; LINKS and NEAR: pairs that the rules link
    or nearly link; STARS: instead of links, from each listing to the first of those that links of this pair of tiles join it to. best_bits is exact up to the near-miss limit, else 999.
    """
    key = rows.schema["k"].dataType.simpleString()
    schema = f"a {key}, b {key}" + ("" if keep == STARS else ", hits int, best_bits int, attrs boolean, price boolean, text_sim double, both_photos boolean")

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        yield from Tiles(table, keep, rules).pairs()

    return tile_pairs(rows).groupBy("place", "lo", "hi").applyInArrow(of_group, schema)


def hashes(photos: Column, value) -> Column:
    return F.transform(photos, lambda p: F.struct(value(p["phash"]).alias("p"), value(p["dhash"]).alias("d")))


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equal values have equal numbers; null is -1."""
    coded = pc.dictionary_encode(column)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return np.asarray(coded.indices.fill_null(-1), dtype=np.int64)


def _floats(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and which of them are known."""
    return np.asarray(column.cast(pa.float64()).fill_null(0.0), dtype=np.float64), np.asarray(column.is_valid(), dtype=bool)


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n of the counts, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Side:
    """Listings of a tile, by rooms (unknown last) and text; photos' hashes lie in the order of their listings."""

    def __init__(self, table: pa.Table, at: np.ndarray, of: "Tiles") -> None:
        self.rows = at[np.lexsort((of.text[at], of.rooms[at]))]
        self.n = len(self.rows)
        for name in ("rooms", "text", "area", "land", "land_known", "price", "price_known", "pictured", "coded", "named", "rank"):
            setattr(self, name, getattr(of, name)[self.rows])
        photos = table["photos"].combine_chunks().take(pa.array(self.rows))
        counts = np.asarray(photos.value_lengths().fill_null(0), dtype=np.int64)
        flat, owner = photos.flatten(), np.repeat(np.arange(self.n), counts)
        self.owner, self.kinds = owner, []
        for kind in ("p", "d"):
            value = pc.struct_field(flat, kind)
            some = np.flatnonzero(np.asarray(value.is_valid(), dtype=bool))
            self.kinds.append((some, np.asarray(value.fill_null(0), dtype=np.int64).view(np.uint64)[some]))


class Tiles:
    """A pair of tiles, or one tile with itself."""

    def __init__(self, table: pa.Table, keep: str, rules: dict) -> None:
        self.keep, self.rules, self.keys = keep, rules, table["k"].combine_chunks()
        low = np.asarray(table["low"], dtype=bool)
        rooms = _ids(table["rooms"])
        self.rooms = np.where(rooms < 0, UNKNOWN, rooms)
        self.area, area_known = _floats(table["area_m2"])
        self.land, self.land_known = _floats(table["land_m2"])
        self.price, self.price_known = _floats(table["price"])
        self.pictured = np.asarray(pc.greater(pc.coalesce(pc.list_value_length(table["photos"]), pa.scalar(0, pa.int32())), 0), dtype=bool)
        self.coded, self.named = np.asarray(table["code"].is_valid(), dtype=bool), _ids(table["named"])
        coded = pc.dictionary_encode(table["text"].combine_chunks())
        self.text = np.asarray(coded.indices, dtype=np.int64)
        self._shingle(coded.dictionary.to_pylist())
        ordered = pc.rank(self.keys, sort_keys="ascending", tiebreaker="dense")
        self.rank = np.asarray(ordered, dtype=np.int64)
        self.repeated = len(np.unique(self.rank)) < len(self.rank)
        self.odd = bool(np.isnan(self.land).any() or np.isnan(self.price).any())
        first = table.slice(0, 1).to_pylist()[0]
        self.alone = first["lo"] == first["hi"]
        # Areas two buckets apart, or unknown, never match.
        self.sized = bool(area_known.all()) and first["hi"]["at"] - first["lo"]["at"] <= 1
        everyone = np.arange(len(low))
        self.left = Side(table, everyone if self.alone else everyone[low], self)
        self.right = self.left if self.alone else Side(table, everyone[~low], self)
        self.apart = table["apart"].combine_chunks() if "apart" in table.column_names else None
        self.component = np.arange(self.rank.max() + 1)

    def _shingle(self, texts: list[str]) -> None:
        """Each text's distinct shingles as numbers, one text after the other."""
        known, n = {}, self.rules["shingle"]
        self.grams = []
        for text in texts:
            words = text.split()
            grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else set(words)
            self.grams.append({known.setdefault(g, len(known)) for g in grams})
        self.size = np.array([len(g) for g in self.grams], dtype=np.int64)
        self.flat = np.fromiter((g for s in self.grams for g in s), dtype=np.int64, count=int(self.size.sum()))
        self.start, self.vocabulary = np.cumsum(self.size) - self.size, len(known)

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Jaccard likeness of each of the left texts to each of the right ones."""
        sl, sr = self.size[left], self.size[right]
        at = np.repeat(self.start[left], sl) + _spread(sl)
        gram, row = self.flat[at], np.repeat(np.arange(len(left)), sl)
        row, counts = row[np.argsort(gram, kind="stable")], np.bincount(gram, minlength=self.vocabulary)
        begin = np.cumsum(counts) - counts
        other, col = self.flat[np.repeat(self.start[right], sr) + _spread(sr)], np.repeat(np.arange(len(right)), sr)
        times = counts[other]
        met = row[np.repeat(begin[other], times) + _spread(times)] * len(right) + np.repeat(col, times)
        common = np.bincount(met, minlength=len(left) * len(right)).reshape(len(left), len(right))
        union = sl[:, None] + sr[None, :] - common
        return np.where((sl[:, None] > 0) & (sr[None, :] > 0), common / np.maximum(union, 1), 0.0)

    def near_photos(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """i, j (places in left and right), best bits and hits of the pairs with photos within the near-miss limit."""
        limit, l, r, found = self.rules["near_bits"], self.left, self.right, []  # noqa: E741
        for (pl, vl), (pr, vr) in zip(l.kinds, r.kinds, strict=True):
            for s in range(0, len(vl), 512):
                for t in range(s if self.alone else 0, len(vr), 512):
                    bits = np.bitwise_count(vl[s : s + 512, None] ^ vr[None, t : t + 512])
                    hit = np.flatnonzero(bits <= limit)
                    if len(hit):
                        x, y = np.divmod(hit, bits.shape[1])
                        found.append(np.stack([pl[x + s], pr[y + t], bits.ravel()[hit]]))
        p, q, bits = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        i, j = l.owner[p], r.owner[q]
        ok = (l.rank[i] != r.rank[j]) & ((i < j) if self.alone else True)
        p, q, bits, i, j = (x[ok] for x in (p, q, bits, i, j))
        pair, at = np.unique(i * r.n + j, return_inverse=True)
        best = np.full(len(pair), 64)
        np.minimum.at(best, at, bits)
        i, j = np.divmod(pair, r.n)
        # Hits are photos of the pair's first listing.
        photo = np.where(l.rank[i][at] < r.rank[j][at], p, q)
        hit = np.unique(np.stack([at, photo])[:, bits <= self.rules["bits"]], axis=1)[0]
        return i, j, best, np.bincount(hit, minlength=len(pair))

    def _forbidden(self) -> tuple[np.ndarray, np.ndarray]:
        """i, j of the pairs that are not to be compared."""
        if self.apart is None or self.apart.null_count == len(self.apart):
            return (np.zeros(0, dtype=np.int64),) * 2
        owner = np.repeat(np.arange(len(self.apart)), np.asarray(self.apart.value_lengths().fill_null(0), dtype=np.int64))
        other = pc.index_in(self.apart.flatten(), self.keys)
        some = np.asarray(other.is_valid(), dtype=bool)
        x, y = owner[some], np.asarray(other.fill_null(0), dtype=np.int64)[some]
        at = [np.full(len(self.keys), -1) for _ in "lr"]
        for to, side in zip(at, (self.left, self.right), strict=True):
            to[side.rows] = np.arange(side.n)
        x, y = np.concatenate([x, y]), np.concatenate([y, x])
        i, j = at[0][x], at[1][y]
        ok = (i >= 0) & (j >= 0) & ((i < j) if self.alone else True)
        return i[ok], j[ok]

    def _match(self, i, j) -> np.ndarray:
        """Whether attributes match; i, j: indices that broadcast."""
        l, r, rules = self.left, self.right, self.rules  # noqa: E741
        ok = np.abs(l.area[i] - r.area[j]) <= rules["area"]
        return ok & self._land(i, j) & (l.coded[i] & r.coded[j] | (l.named[i] == r.named[j]))

    def _land(self, i, j) -> np.ndarray:
        a, b = self.left.land[i], self.right.land[j]
        most = self.rules["land"] * np.maximum(a, b)
        return self._within(a, b, most) | ~(self.left.land_known[i] & self.right.land_known[j])

    def _price(self, i, j) -> np.ndarray:
        a, b = self.left.price[i], self.right.price[j]
        most = self.rules["price"] * np.maximum(a, b)
        return self._within(a, b, most) & self.left.price_known[i] & self.right.price_known[j]

    def _within(self, a, b, most) -> np.ndarray:
        """As Spark compares: NaN is equal to itself and above all else."""
        near = np.abs(a - b) <= most
        return near | np.isnan(most) if self.odd else near

    def _wanted(self, match, price, both, loose, strict):
        """Of pairs without near photos, those that ``keep`` asks for."""
        if self.keep == ALL:
            return match
        link = match & np.where(both, price & strict, price & loose | strict)
        return link if self.keep != NEAR else match & ~link & (price | loose)

    def pairs(self) -> Iterator[pa.RecordBatch]:
        l, r, keep = self.left, self.right, self.keep  # noqa: E741
        if not l.n or not r.n:
            return
        fi, fj = self._forbidden()
        i, j, best, hits = self.near_photos()
        free = ~np.isin(i * r.n + j, fi * r.n + fj)
        # Pairs that are measured one by one, and those that blocks leave out.
        out_i, out_j = np.concatenate([i, fi]), np.concatenate([j, fj])
        i, j, best, hits = i[free], j[free], best[free], hits[free]
        rooms = (l.rooms[i] == r.rooms[j]) | (l.rooms[i] == UNKNOWN) | (r.rooms[j] == UNKNOWN)
        match, price = rooms & self._match(i, j) & self.sized, self._price(i, j)
        sets = [(self.grams[x], self.grams[y]) for x, y in zip(l.text[i], r.text[j], strict=True)]
        text = np.array([len(x & y) / len(x | y) if x and y else 0.0 for x, y in sets], dtype=np.float64)
        if keep in (LINKS, STARS):
            ok = (hits > 0) | self._wanted(match, price, True, text >= self.rules["text"], text >= self.rules["text_strict"])
        elif keep == NEAR:
            ok = (hits == 0) & ~(match & price & (text >= self.rules["text_strict"]))
        else:
            ok = np.ones(len(i), dtype=bool)
        yield from self._given(i[ok], j[ok], [x[ok] for x in (hits, best, match, price, text, np.ones(len(i), dtype=bool))])
        if self.sized:
            yield from self._blocks(out_i, out_j)
        if keep == STARS:
            yield from self._stars()

    def _blocks(self, out_i: np.ndarray, out_j: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs without near photos whose attributes match: listings of equal or unknown rooms meet, block by block."""
        l, r, rules = self.left, self.right, self.rules  # noqa: E741
        order = np.argsort(out_i, kind="stable")
        out_i, out_j = out_i[order], out_j[order]
        nothing = int(np.searchsorted(r.rooms, UNKNOWN))
        lt, rt = np.unique(l.text), np.unique(r.text)
        whole = self._texts(lt, rt) if len(lt) * len(rt) <= TEXTS else None
        right_text = np.searchsorted(rt, r.text)
        codes_known = bool(l.coded.all() and r.coded.all())
        for room in np.unique(l.rooms):
            first, end = (int(np.searchsorted(l.rooms, room, s)) for s in ("left", "right"))
            if room == UNKNOWN:
                meet = np.arange(nothing if self.alone else 0, r.n)
            else:
                same = np.arange(*(int(np.searchsorted(r.rooms, room, s)) for s in ("left", "right")))
                meet = np.concatenate([same, np.arange(nothing, r.n)])
            if not len(meet):
                continue
            place = np.full(r.n, -1)
            place[meet] = np.arange(len(meet))
            side = max(1, BLOCK // len(meet))
            for s in range(first, end, side):
                rows = np.arange(s, min(s + side, end))
                off = s - first if self.alone else 0
                cols = meet[off:]
                i, j = rows[:, None], cols[None, :]
                ok = np.ones((len(rows), len(cols)), dtype=bool)
                if self.alone:
                    ok[:, : len(rows)] = rows[:, None] < cols[None, : len(rows)]
                if self.keep == STARS:
                    a, b = self.component[l.rank[rows]], self.component[r.rank[cols]]
                    if a.min() == a.max() == b.min() == b.max():
                        continue
                    ok &= a[:, None] != b[None, :]
                area = l.area[rows], r.area[cols]
                if max(x.max() for x in area) - min(x.min() for x in area) > rules["area"]:
                    ok &= np.abs(area[0][:, None] - area[1][None, :]) <= rules["area"]
                if l.land_known[rows].any() and r.land_known[cols].any():
                    ok &= self._land(i, j)
                if not codes_known:
                    ok &= l.coded[i] & r.coded[j] | (l.named[i] == r.named[j])
                if self.repeated:
                    ok &= l.rank[i] != r.rank[j]
                x, y = (int(np.searchsorted(out_i, v)) for v in (rows[0], rows[-1] + 1))
                if y > x:
                    at = place[out_j[x:y]] - off
                    inside = at >= 0
                    ok[out_i[x:y][inside] - s, at[inside]] = False
                if not ok.any():
                    continue
                price = self._price(i, j)
                near, of = self._texts(np.unique(l.text[rows]), rt) if whole is None else whole, right_text[cols]
                own = np.searchsorted(near[0], l.text[rows])
                class_ = np.take(near[2][own], of, axis=1)
                both = l.pictured[i] & r.pictured[j]
                at = np.flatnonzero(self._wanted(ok, price, both, class_ >= 1, class_ == 2))
                if len(at):
                    x, y = np.divmod(at, len(cols))
                    none, some = np.zeros(len(at), dtype=np.int32), np.ones(len(at), dtype=bool)
                    far = np.full(len(at), rules["no_hash"], dtype=np.int32)
                    yield from self._given(rows[x], cols[y], (none, far, some, price.ravel()[at], near[1][own[x], of[y]], both.ravel()[at]))

    def _texts(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        like = self.likeness(left, right)
        return left, like, (like >= self.rules["text"]).astype(np.uint8) + (like >= self.rules["text_strict"])

    def _given(self, i: np.ndarray, j: np.ndarray, measures) -> Iterator[pa.RecordBatch]:
        """Rows of the pairs, the lesser key first; for STARS their components are joined and nothing is given."""
        if self.keep == STARS:
            self._join(self.left.rank[i], self.right.rank[j])
        elif len(i):
            types = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.float64(), pa.bool_())
            names = ("hits", "best_bits", "attrs", "price", "text_sim", "both_photos")
            x, y = self.left.rows[i], self.right.rows[j]
            swap = self.rank[x] > self.rank[y]
            ends = self._ends(np.where(swap, y, x), np.where(swap, x, y))
            yield pa.RecordBatch.from_pydict(ends | {n: pa.array(v, type=t) for n, v, t in zip(names, measures, types, strict=True)})

    def _ends(self, a: np.ndarray, b: np.ndarray) -> dict[str, pa.Array]:
        return {"a": self.keys.take(pa.array(a)), "b": self.keys.take(pa.array(b))}

    def _join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Components of pairs of ranks become one; a component is named by its least rank."""
        while len(x):
            a, b = self.component[x], self.component[y]
            apart = a != b
            x, y, a, b = (v[apart] for v in (x, y, a, b))
            hooked, chosen = np.unique(np.maximum(a, b), return_index=True)
            to = np.arange(len(self.component))
            to[hooked] = np.minimum(a, b)[chosen]
            while not np.array_equal(further := to[to], to):
                to = further
            self.component = to[self.component]

    def _stars(self) -> Iterator[pa.RecordBatch]:
        row = np.zeros(len(self.component), dtype=np.int64)
        row[self.rank] = np.arange(len(self.rank))
        of = self.component[self.rank]
        member = np.flatnonzero(of != self.rank)
        if len(member):
            yield pa.RecordBatch.from_pydict(self._ends(row[of[member]], member))
