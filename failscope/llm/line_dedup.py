"""Line dedup by a segment-partition edit join.

Two lines are near each other if their edit distance is at most ``edits``. A line cut into
``edits`` + 1 segments keeps at least one of them whole in every near line, and the lengths
bound where it may lie there. So every distinct line is indexed by (its length, segment number,
segment), and probes the indexes of the lengths from its own down to its own - ``edits`` with
the substrings at the few places that the number of edits left and right of them allows.

1. Distinct lines with their number of uses and first place: hashes only, added up before the
   shuffle, so a line that stands in a third of all documents is one row per task.
2. Hashes of all segments and probes, also distinct before the shuffle; only keys that two
   different lines share go on.
3. Lines that share a key are candidates, unless the characters, or pairs of adjacent ones, that
   they hold an odd number of differ by more than ``edits`` can change: near copies of long lines
   share many keys without being near. A key that very many lines share is not paired: its lines drop the shared segment, and what is left of them (whose distance is no larger) is cut
   again, under the old key, as often as it takes. It is then cut into 2 * ``edits`` + 2 segments,
   of which near lines share all but ``edits``: a key holds all those shared, so it says more and
   leaves less. Ends common to all that is left under a key go first, and keys that leave the same
   become one. What is too short to be cut is paired under the old key with all that is as short,
   and by common subsequences with what is up to ``edits`` longer.
4. Candidates are verified on their text: common ends are cut off, the rest goes through the
   bit-parallel edit distance, banded by the number of edits.

A line counts as often as it and its near lines are used; where that is more than ``allowed``
times, only the first of all these places keeps it. A line of ``passage`` words or more, or near
one, may be used once only. Documents that lose all their lines go; the
others keep their order of lines and all other columns.

Lines are what lies between newlines. Lines of fewer than ``least`` characters (without outer
white space) are never dropped. Lines are compared by 128-bit hashes, near ones by their text.
Null texts stay null, empty ones empty. The first place is the least (doc_id, line number), then
the least hash of the text; rows without an id come last. Rows that repeat both id and text hold
the same places, so they lose the same lines; different texts of one id, or without one, are
decided on their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import counted, saved, small
from failscope.llm.shingles import mix, powers
from failscope.session import new_path, write_observed

#: Pairs of lines under one key beyond which the key is refined instead of paired. The join compares
#: two words of each pair and keeps few, so 64 lines with one another cost less than cutting them again.
PAIRS_PER_KEY = 4_096
#: Bits of a line's words (``_Segments.odd``) that an edit flips at most.
FLIPS = {"ones": 2, "twos": 4}
#: Words from which on a line is a passage, of which every further use is lost.
PASSAGE = 50
#: Keys (one number each) of a broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def _common(a: str, b: str) -> int:
    """Characters that the beginnings of a and b have in common, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return low


def bounded_distance(a: str, b: str, most: int) -> int:
    """Edit distance of a and b if it is at most ``most``, else ``most`` + 1.

    Bit-parallel: a column of the table is two words of vertical differences. Only the band of
    2 * ``most`` + 1 diagonals is kept, so a word has that many bits whatever the length. A column
    whose least value is above ``most`` ends it, as later ones hold none smaller.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = _common(a, b)
    a, b = a[start:], b[start:]
    end = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    # rows follow a, columns follow b; bit i of a column's words is row j - most + i
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    plus, minus = full & ~((1 << most) - 1), 0
    value = min(most, len(a))
    for j, c in enumerate(b, 1):
        at = j - most - 1
        here = rows.get(c, 0)
        equal = (here >> at if at >= 0 else here << -at) & full
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        right_plus = minus | (full & ~(diagonal | plus))
        right_minus = diagonal & plus
        if j + most <= len(a):  # down the band's lowest diagonal, then along the last row
            value += not diagonal & top
        else:
            last = len(a) - j + most
            value += (right_plus >> last & 1) - (right_minus >> last & 1)
        plus = right_minus | (full & ~((diagonal >> 1) | right_plus))
        minus = (diagonal >> 1) & right_plus
        if value - plus.bit_count() > most:  # the last value less all that may lie above it
            return most + 1
    return min(value, most + 1)


def _line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, ta, tb, line_no, line) of all lines; ta and tb are hashes of the text."""
    return docs.where("text IS NOT NULL").select("doc_id", *_text_hashes(F.col("text")), F.posexplode(
        F.split("text", "\n", -1)).alias("line_no", "line"))


def _text_hashes(text: Column) -> list[Column]:
    return [h.alias(name) for h, name in zip(_hashes(text), ("ta", "tb"))]


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("ha"), F.xxhash64(F.lit(1), line).alias("hb")]


#: Seeds that give the same 64-bit hashes of a line in a task as ``_hashes`` gives.
_SEEDS = (42, xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=42))
#: Lines whose keys a task remembers having sent, so that a frequent line is sent once.
_SENT_LINES = 200_000
#: Characters of texts that are cut together; a longer text is on its own.
_CHARS = 1 << 18
_U = np.uint64
_KEYS = "key long, ha long, probe boolean, hb long, old long, rest long, way int, ones long, twos long"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: One way in which a line matches a near one: which of its segments are left out, in runs
#: (first, after the last), how many characters longer each run is than in the shorter line, and
#: how many the whole line is.
_Way = tuple[tuple[tuple[int, int], ...], tuple[int, ...], int]


def ways(edits: int, cuts: int) -> list[_Way]:
    """All ways for lines cut into ``cuts`` segments that share all but ``edits`` of them.

    Let every edit take the segment it lies in, or the next free one if that is taken: then a run of
    taken segments holds as many edits as segments, so it is longer or shorter by at most as many
    characters. At most ``edits`` segments are taken; leaving out more of them does no harm.
    """
    found = []
    for gone in combinations(range(cuts), edits):
        starts = [i for i in gone if i - 1 not in gone]
        runs = tuple((i, next(j for j in range(i, cuts + 1) if j not in gone)) for i in starts)
        for longer in product(*[range(i - j, j - i + 1) for i, j in runs]):
            if sum(longer) >= 0:
                found.append((runs, longer, sum(longer)))
    return found


def _left_out(line: str, way: _Way, cuts: int) -> str:
    """The characters of ``line`` in the segments that ``way`` leaves out."""
    runs, longer, less = way
    even, more = divmod(len(line) - less, cuts)
    parts, shift = [], 0
    for (i, j), by in zip(runs, longer):
        begin = i * even + max(i - (cuts - more), 0) + shift
        shift += by
        parts.append(line[begin: j * even + max(j - (cuts - more), 0) + shift])
    return "".join(parts)


class _Segments:
    """Keys of the segments and probes of many lines, by prefix sums over all their characters.

    A line has ``cuts`` even segments, of which near lines share all but ``edits``. The head is what a
    key holds besides the shared segments: which they are, and the indexed line's length. A key is a
    hash of the segments, the head and ``old``. Keys only choose candidates, which are verified on
    their text, so a collision costs a comparison.
    """

    def __init__(self, lines: list[str], old: np.ndarray, edits: int, cuts: int) -> None:
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
        up, down = powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + _U(1)) * up[: len(codes)], out=sums[1:])
        first = np.cumsum(lengths) - lengths
        seeds = mix(old.view(np.uint64) + _U(1))
        found: list[list[np.ndarray]] = [[] for _ in range(4)]
        kinds: dict[tuple, int] = {}
        # a probe for the indexes of lines shorter by `less`; the later segments take the remainder
        for number, (runs, longer, less) in enumerate(ways(edits, cuts)):
            short = lengths - less
            even, more = np.divmod(short, cuts)
            fits, shift, at, spans = short > edits, 0, 0, []
            for (i, j), by in zip((*runs, (cuts, cuts)), (*longer, 0)):
                begin, end = (k * even + np.maximum(k - (cuts - more), 0) for k in (at, i))
                if at < i:
                    spans.append((begin + shift, end + shift))
                run = j * even + np.maximum(j - (cuts - more), 0) - end
                fits &= run + by >= 0
                shift, at = shift + by, j
            rows = np.flatnonzero(fits)
            head = (kinds.setdefault(runs, len(kinds)) << 40 | short[rows]).astype(np.uint64)
            key = mix(seeds[rows] + head * _U(0x9E3779B97F4A7C15))
            for begin, end in spans:
                low, high = first[rows] + begin[rows], first[rows] + end[rows]
                key = mix((sums[high] - sums[low]) * down[low] ^ key)
            for part, values in zip(found, (
                    rows, key.view(np.int64), np.full(len(rows), any(longer)),
                    np.full(len(rows), number, np.int32))):
                part.append(values)
        #: The line's number, key, whether it is a probe, and the way it matches.
        self.line, self.key, self.probe, self.way = (np.concatenate(p) for p in found)
        self._codes, self._first, self._lengths = codes, first, lengths

    def odd(self) -> tuple[np.ndarray, np.ndarray]:
        """Two words for each line: of which of 64 kinds of characters, and of pairs of adjacent ones,
        it holds an odd number.

        An edit takes away and adds at most one character each, and two pairs each (``FLIPS``).
        """
        full = np.flatnonzero(self._lengths)
        ones, twos = np.zeros((2, len(self._first)), _U)
        if len(full):
            codes = self._codes.astype(np.uint64)
            pairs = (codes[:-1] * _U(0x9E3779B97F4A7C15) + codes[1:]) * _U(0xD6E8FEB86659FD93) >> _U(58)
            pairs = np.append(_U(1) << pairs, _U(0))
            pairs[(self._first + self._lengths)[full] - 1] = 0
            ones[full] = np.bitwise_xor.reduceat(_U(1) << (codes & _U(63)), self._first[full])
            twos[full] = np.bitwise_xor.reduceat(pairs, self._first[full])
        return ones.view(np.int64), twos.view(np.int64)


def _new_lines(texts: list, least: int, sent: set[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lines of at least ``least`` characters that are not among ``sent``, with their hashes."""
    digest, lines, ha, hb = xxhash.xxh64_intdigest, [], [], []
    for text in texts:
        for line in text.split("\n") if text else ():
            if len(line) >= least and len(line.strip(" ")) >= least:
                raw = line.encode("utf-8", "surrogatepass")
                one = digest(raw, seed=_SEEDS[0])
                if one not in sent:
                    if len(sent) >= _SENT_LINES:
                        sent.clear()
                    sent.add(one)
                    lines.append(line)
                    ha.append(one)
                    hb.append(digest(raw, seed=_SEEDS[1]))
    return lines, np.array(ha, np.uint64).view(np.int64), np.array(hb, np.uint64).view(np.int64)


def _text_keys(docs: DataFrame, edits: int, least: int, whole: bool) -> DataFrame:
    """Segments and probes of all lines of (text) rows: (key, ha, probe), and with ``whole`` also
    (hb, old, rest, way, ones, twos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            texts, at = batch.column(0).to_pylist(), 0
            while at < len(texts):
                to, chars = at + 1, len(texts[at] or "")
                while to < len(texts) and chars + len(texts[to] or "") <= _CHARS:
                    chars, to = chars + len(texts[to] or ""), to + 1
                lines, ha, hb = _new_lines(texts[at:to], least, sent)
                found = _Segments(lines, np.zeros(len(lines), np.int64), edits, edits + 1)
                columns = {"key": found.key, "ha": ha[found.line], "probe": found.probe}
                if whole:
                    none = np.zeros(len(found.key), np.int64)
                    columns |= {"hb": hb[found.line], "old": none, "rest": none, "way": found.way}
                    columns |= {n: odd[found.line] for n, odd in zip(FLIPS, found.odd())}
                yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})
                at = to

    return docs.select("text").mapInArrow(run, _KEYS if whole else "key long, ha long, probe boolean")


def _line_keys(lines: DataFrame, edits: int, cuts: int) -> DataFrame:
    """(key, ha, probe, hb, old, rest, way, ones, twos) of rows (ha, hb, old, rest, line, ones, twos), under
    the key ``old``; ``rest`` tells what is left of a line in one way from what is left in another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(4).to_pylist(), 0
            while at < len(texts):
                to, chars = at + 1, len(texts[at])
                while to < min(len(texts), at + 4_096) and chars + len(texts[to]) <= _CHARS:
                    chars, to = chars + len(texts[to]), to + 1
                ha, hb, old, rest, ones, twos = (
                    batch.column(i).slice(at, to - at).to_numpy() for i in (0, 1, 2, 3, 5, 6))
                found = _Segments(texts[at:to], old, edits, cuts)
                own, at = found.line, to
                yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in {
                    "key": found.key, "ha": ha[own], "probe": found.probe, "hb": hb[own], "old": old[own],
                    "rest": rest[own], "way": found.way, "ones": ones[own], "twos": twos[own]}.items()})

    return lines.select("ha", "hb", "old", "rest", "line", *FLIPS).mapInArrow(run, _KEYS)


def _remainders(lines: DataFrame, edits: int, cuts: int) -> DataFrame:
    """(ha, hb, old, line, ones, twos): what (ha, hb, key, line, way, ones, twos) leaves of a line,
    under its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ways(edits, cuts)
        for batch in batches:
            left = [_left_out(line, known[way], cuts) for line, way in zip(
                batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(left, pa.string()), *batch.columns[5:]],
                names=["ha", "hb", "old", "line", *FLIPS])

    return lines.select("ha", "hb", "key", "line", "way", *FLIPS).mapInArrow(
        run, "ha long, hb long, old long, line string, ones long, twos long").distinct()


def _shared(keys: DataFrame, rows: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """The distinct ``rows`` whose key different lines share and that indexes one of them, and
    their number.

    ``keys``: (key, ha, probe) of the same rows, of which there are at most ``most``.
    """
    per = keys.groupBy("key").agg(
        F.min("ha").alias("low"), F.max("ha").alias("high"), F.min("probe").alias("probe"))
    keys, n = counted(per.where("low != high AND NOT probe").select("key"), "shared-keys", most)
    return counted(rows.join(
        F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "key", "left_semi").distinct(), "shared-rows", most)


def _subsequences(lines: DataFrame, edits: int) -> DataFrame:
    """(key, ha, hb, probe) of (ha, hb, old, line): keys of ``old`` and the line without up to
    ``edits`` of its characters. Lines within ``edits`` of each other share one of them.

    Lines of at most ``edits`` characters are indexed, longer ones are probes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            found: list[tuple] = []
            for ha, hb, old, line in zip(*[c.to_pylist() for c in batch.columns]):
                left = {"".join(c) for n in range(max(0, len(line) - edits), len(line) + 1)
                        for c in combinations(line, n)}
                found += [(_signed(digest(x, seed=old & 0xFFFFFFFFFFFFFFFF)), ha, hb, len(line) > edits)
                          for x in left]
            kinds = (pa.int64(),) * 3 + (pa.bool_(),)
            columns = zip(*found) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "ha", "hb", "probe"])

    return lines.select("ha", "hb", "old", "line").mapInArrow(
        run, "key long, ha long, hb long, probe boolean").distinct()


def _paired(rows: DataFrame, indexed: bool = True, edits: int | None = None) -> DataFrame:
    """Different lines of one key, one of them an indexed one, as ordered pairs of hashes.

    Without ``indexed``: only an indexed one and a probe. With ``edits``: only those whose words
    (ones and twos, of the whole lines) allow that few edits.
    """
    a, b = rows.where("NOT probe").alias("a"), (rows if indexed else rows.where("probe")).alias("b")
    one = F.struct("a.ha", "a.hb")
    two = F.struct("b.ha", "b.hb")
    both = a.join(b, F.col("a.key") == F.col("b.key")).where(
        (F.col("b.probe") & (one != two)) | (one < two))
    if edits is not None:
        for word, most in FLIPS.items():
            both = both.where(F.bit_count(F.col(f"a.{word}").bitwiseXOR(F.col(f"b.{word}"))) <= most * edits)
    low, high = F.least(one, two), F.greatest(one, two)
    return both.select(low.getField("ha").alias("xa"), low.getField("hb").alias("xb"),
                       high.getField("ha").alias("ya"), high.getField("hb").alias("yb"))


def _bared(rest: DataFrame, n: int, n_old: int) -> DataFrame:
    """``rest``, ``n`` rows (ha, hb, old, line, ones, twos) of ``n_old`` old ones, without the ends that all
    lines of an ``old`` have in common; of those whose lines are then the same, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for low, high, back_low, back_high, least in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                heads.append(len(commonprefix([low, high])))
                tails.append(min(len(commonprefix([back_low, back_high])), least - heads[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(heads, pa.int32()), pa.array(tails, pa.int32())],
                names=["old", "head", "tail"])

    back = F.reverse("line")
    ends = saved(rest.groupBy("old").agg(  # the first and last in order share what all share
        F.min("line").alias("low"), F.max("line").alias("high"), F.min(back).alias("back_low"),
        F.max(back).alias("back_high"), F.min(F.char_length("line")).alias("least")).mapInArrow(
        run, "old long, head int, tail int"), "common-ends", n_old)
    bare = saved(rest.join(small(ends, n_old), "old").select("ha", "hb", "old", F.substr(
        "line", F.col("head") + 1, F.char_length("line") - F.col("head") - F.col("tail")).alias("line"),
        *FLIPS), "bare-lines", n)
    row = ["ha", "hb", "line"]
    sets = bare.groupBy("old").agg(
        F.bit_xor(F.xxhash64(*row)).alias("sa"), F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("sb"),
        F.count(F.lit(1)).alias("n"))
    chosen = saved(sets.groupBy("sa", "sb", "n").agg(F.min("old").alias("old")).select("old"), "distinct-keys", n_old)
    return bare.join(small(chosen, n_old), "old", "left_semi")


def candidates(docs: DataFrame, lines: DataFrame, edits: int, least: int) -> DataFrame:
    """Distinct pairs (xa, xb, ya, yb) of hashes of lines that share a segment and may be near.

    ``lines``: (ha, hb, line) of the same documents, where a line may stand more than once.
    """
    source, found = lines.select(
        "ha", "hb", F.lit(0).cast("long").alias("old"), F.lit(0).cast("long").alias("rest"), "line"), []
    rows, n_rows = _shared(_text_keys(docs, edits, least, False), _text_keys(docs, edits, least, True))
    cuts = edits + 1
    while True:
        bare = rows.select("key", "ha", "hb", "probe", *FLIPS).distinct()
        hot, n_hot = counted(bare.groupBy("key").agg(
            F.count(F.when(~F.col("probe"), 1)).alias("indexed"), F.count(F.lit(1)).alias("all")
        ).where(F.col("indexed") * F.col("all") > PAIRS_PER_KEY).select("key"), "hot-keys", n_rows)
        # of the lines under a key that is paired, at most so many are indexed
        found.append(saved(_paired(bare.join(small(hot, n_hot), "key", "left_anti"), True, edits).distinct(),
                           "line-pairs", n_rows * math.isqrt(PAIRS_PER_KEY)))
        if not n_hot:
            break
        # a hot key's lines without the shared segments, to be cut again under that key
        again = rows.join(small(hot, n_hot), "key", "left_semi")
        one = ["ha", "hb", "old", "rest"]
        wanted, n = counted(again.select(*one).distinct(), "hot-lines", n_rows)
        texts = source.join(small(wanted, n), one, "left_semi").dropDuplicates(one).select(*one, "line")
        rest, n = counted(_remainders(again.join(texts, one), edits, cuts), "refined", n_rows)
        path = new_path(docs.sparkSession, "bared")
        seen = write_observed(_bared(rest, n, n_hot), path, shortest=F.min(F.char_length("line")))
        rest = docs.sparkSession.read.schema("ha long, hb long, old long, line string, ones long, twos long").parquet(path)
        source = rest.select("ha", "hb", "old", F.xxhash64("line").alias("rest"), "line", *FLIPS)
        n = seen["rows"]
        if n and seen["shortest"] <= 2 * edits:
            ends = rest.where(F.char_length("line") <= edits)  # nothing left to tell lines apart by
            found.append(saved(_paired(ends.select(
                F.col("old").alias("key"), "ha", "hb", F.lit(False).alias("probe")).distinct()
            ).distinct(), "line-pairs"))
            # lines of which so little is left may be near ones of which more is left
            brief = rest.where(F.char_length("line") <= 2 * edits)
            found.append(saved(_paired(saved(_subsequences(brief, edits), "brief-keys"), False).distinct(),
                               "line-pairs"))
            source, n = counted(source.where(F.char_length("line") > edits), "refined-lines", n)
        if not n:
            break
        cuts = 2 * edits + 2
        cut_rows = _line_keys(source, edits, cuts)
        rows, n_rows = _shared(cut_rows, cut_rows, n * len(ways(edits, cuts)))
    return reduce(DataFrame.union, found).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Pairs whose lines are within ``edits`` of each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [bounded_distance(x, y, edits) <= edits for x, y in zip(
                batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(near, pa.bool_()))

    a = texts.select(F.col("ha").alias("xa"), F.col("hb").alias("xb"), F.col("line").alias("x"))
    b = texts.select(F.col("ha").alias("ya"), F.col("hb").alias("yb"), F.col("line").alias("y"))
    return pairs.join(a, ["xa", "xb"]).join(b, ["ya", "yb"]).select(
        "xa", "xb", "ya", "yb", "x", "y").mapInArrow(run, "xa long, xb long, ya long, yb long")


def _long(line: Column, passage: int) -> Column:
    """Whether a line has ``passage`` words or more; those with fewer characters are not split."""
    return F.when(F.char_length(line) >= 2 * passage - 1, F.size(F.split(
        F.trim(F.regexp_replace(line, r"\s+", " ")), " ")) >= passage).otherwise(False)


def near_lines(docs: DataFrame, edits: int = 2, least: int = 20,
               passage: int = PASSAGE) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (ha, hb, used, long) and the links (xa, xb, ya, yb) between near ones."""
    if least < 4 * (edits + 1):
        raise ValueError("lines this short have no segments to share")
    lines = _line_rows(docs).where(F.char_length(F.trim("line")) >= least)
    keyed = lines.select("doc_id", "line_no", "line", *_hashes(F.col("line")))
    distinct = saved(keyed.groupBy("ha", "hb").agg(
        F.count(F.lit(1)).alias("used"), F.max(_long(F.col("line"), passage)).alias("long")), "distinct-lines")
    pairs = saved(candidates(docs, keyed.select("ha", "hb", "line"), edits, least), "line-candidates")
    wanted, n = counted(pairs.select(F.col("xa").alias("ha"), F.col("xb").alias("hb")).union(
        pairs.select("ya", "yb")).distinct(), "candidate-lines")
    texts = saved(keyed.select("ha", "hb", "line").join(
        small(wanted, n), ["ha", "hb"], "left_semi").dropDuplicates(["ha", "hb"]), "line-texts")
    return distinct, saved(_verified(pairs, texts, edits), "near-lines")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no", "ta", "tb")


def _decided(docs: DataFrame, edits: int, least: int, allowed: int, passage: int,
             copies: bool = True) -> DataFrame:
    """(doc_id, ta, tb, drop): sorted numbers of the lines that each text of an id loses."""
    distinct, links = near_lines(docs, edits, least, passage)
    both = links.union(links.select("ya", "yb", "xa", "xb"))
    near = distinct.select(F.col("ha").alias("ya"), F.col("hb").alias("yb"), "used", F.col("long").alias("near_long"))
    more = both.join(near, ["ya", "yb"]).groupBy(F.col("xa").alias("ha"), F.col("xb").alias("hb")).agg(
        F.sum("used").alias("more"), F.max("near_long").alias("near_long"))
    uses = F.col("used") + F.coalesce("more", F.lit(0))
    long = F.col("long") | F.coalesce("near_long", F.lit(False))
    often = saved(distinct.join(more, ["ha", "hb"], "left").where(
        (uses > allowed) | (long & (uses > 1))).select("ha", "hb", (uses > allowed).alias("many")), "frequent-lines")
    # each of them with itself and its near lines, and where all of these stand
    around = often.select("ha", "hb", "many", F.col("ha").alias("ya"), F.col("hb").alias("yb")).union(
        often.join(both.toDF("ha", "hb", "ya", "yb"), ["ha", "hb"]))
    involved, n = counted(around.select(F.col("ya").alias("ha"), F.col("yb").alias("hb")).distinct(),
                          "involved-lines")
    places = saved(_line_rows(docs).select("doc_id", "ta", "tb", "line_no", *_hashes(F.col("line"))).join(
        small(involved, n), ["ha", "hb"], "left_semi"), "line-places")
    first = places.groupBy(F.col("ha").alias("ya"), F.col("hb").alias("yb")).agg(
        F.min(_place()).alias("first"))
    keep, n = counted(around.join(first, ["ya", "yb"]).groupBy("ha", "hb").agg(
        F.min("first").alias("keep"), F.max("many").alias("many")), "kept-places")
    lost = places.join(small(keep, n), ["ha", "hb"]).where(~_place().eqNullSafe(F.col("keep")))
    if not copies:  # rows whose text is the line alone, as is the text that keeps it
        copy = (F.col("ta") == F.col("ha")) & (F.col("tb") == F.col("hb")) & (
            F.col("ta") == F.col("keep.ta")) & (F.col("tb") == F.col("keep.tb"))
        lost = lost.where(F.col("many") | F.col("doc_id").isNull() | ~copy)
    return saved(lost.groupBy("doc_id", "ta", "tb").agg(
        F.sort_array(F.collect_set("line_no")).alias("drop")), "lost-lines")


def _losses(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` and the lines (__drop) that each row loses."""
    own = lost.select(*[F.col(c).alias("__" + c) for c in ("doc_id", "ta", "tb", "drop")])
    ta, tb = _hashes(docs["text"])
    return docs.join(own, docs["doc_id"].eqNullSafe(own["__doc_id"]) & (ta == own["__ta"])
                     & (tb == own["__tb"]), "left")


def _without(text: Column, drop: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(drop, i))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, edits: int = 2, least: int = 20, allowed: int = 6,
                passage: int = PASSAGE, copies: bool = False) -> DataFrame:
    """``docs``, all columns, without lines used too often; documents left empty by it go.

    Without ``copies``, exact copies (with an id) of documents that are one passage stay, if the
    passage is used at most ``allowed`` times: for a near-duplicate stage after this one.
    """
    joined = _losses(docs, _decided(docs, edits, least, allowed, passage, copies))
    text = F.when(F.col("__drop").isNull(), docs["text"]).otherwise(
        _without(docs["text"], F.col("__drop")))
    gone = F.col("__drop").isNotNull() & (F.trim(F.coalesce(F.regexp_replace(
        "__text", "\\s+", " "), F.lit(""))) == "")
    return joined.withColumn("__text", text).where(~gone).select(
        *[F.col("__text").alias("text") if c == "text" else docs[c] for c in docs.columns])


def line_report(docs: DataFrame, edits: int = 2, least: int = 20, allowed: int = 6,
                passage: int = PASSAGE) -> DataFrame:
    """A row per document: doc_id, n_lines, n_dropped, text_sha256 (of what stays)."""
    rows = _losses(docs.select("doc_id", "text"), _decided(docs, edits, least, allowed, passage))
    none = F.col("__drop").isNull()
    kept = F.when(none, F.col("text")).otherwise(_without(F.col("text"), F.col("__drop")))
    return rows.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(none, 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("text_sha256"))
