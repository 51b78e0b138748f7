"""SentencePiece encoding and decoding with the N best segmentations.

A text is normalised as the model says (a leading space, spaces written as a mark) and
segmented over the lattice of the vocabulary's pieces. A forward Viterbi pass gives the best
score of every prefix. Those scores are exact heuristics for an A* search that runs backward
from the end: an entry's priority is the score of its suffix plus the best prefix score (kept
as its loss against the best), so complete segmentations leave the queue in order of their
score. Among equal ones the entry nearest to the start goes first. Characters outside the
vocabulary are byte pieces, each at ``BYTE_COST`` below the worst piece.

No piece crosses a place whose two characters stand side by side in no piece. Texts are cut
there, so the lattice is a chain of small ones, each distinct one solved once while it is
cached (caches are cleared at a fixed size, which only costs time). The forward passes of new
ones of equal length run side by side, over a trie of the pieces with exact keys. The N best of a text
differ from its best in few links of that chain: only the N - 1 links with the least loss can
take part. The forward pass bounds every link's loss from below, so A* runs for links in the
order of that bound until N - 1 exact losses are known to be least, and one more A* over
those links' alternatives gives the N best of the whole text, exactly.

Defined results: null and empty texts have no pieces and one empty segmentation. A mark
(U+2581) in a text decodes to a space, as in the library. Repeated rows each get a row.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import cache, cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import tokenizer_path

MARK = "▁"
BYTE_COST = 10.0
#: Words, links and lists of alternatives at which a cache begins anew. Links repeat more often.
CACHED, CACHED_LINKS, CACHED_LISTS = 250_000, 600_000, 25_000
#: Characters of texts that are solved together; a longer text is a block of its own.
BLOCK_CHARS = 1 << 21
#: Links beyond this length are solved one by one; characters of links that are solved together.
LONGEST, TOGETHER = 40, 1 << 15
#: Lists that are decoded together.
_ROWS = 256
_KIND = "<i4"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A sentencepiece vocabulary as scores of pieces, with byte pieces for the rest."""

    def __init__(self, scored: list[tuple[str, float, int]], bytes_: dict[int, int],
                 dummy_prefix: bool = True) -> None:
        """``scored``: (piece, score, id); ``bytes_``: byte -> id."""
        self.score = {piece: (score, at) for piece, score, at in scored}
        self.text = {at: piece for piece, _, at in scored}
        self.bytes, self.byte_of = bytes_, {at: b for b, at in bytes_.items()}
        self.plain = {**self.text, **{at: chr(b) for b, at in bytes_.items() if b < 128}}
        self.dummy_prefix = dummy_prefix
        self.byte_score = min((s for _, s, _ in scored), default=0.0) - BYTE_COST
        #: Pieces as (score, ids), and None for what only begins a piece.
        self.table: dict[str, tuple | None] = {
            piece[:n]: None for piece in self.score for n in range(1, len(piece))}
        self.table.update({piece: (score, (at,)) for piece, score, at in scored})
        self.joined = {piece[i: i + 2] for piece in self.score for i in range(len(piece) - 1)}
        self.pairs = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in self.joined], np.int64))
        self._trie()
        inner = {pair for pair in self.joined if pair[1] == MARK and pair[0] != MARK}
        self.spaced = not inner  # no piece goes on behind a space that follows another character

    def _trie(self) -> None:
        """The table's strings as nodes; (node, character) -> node in an open table, exact keys."""
        ordered = sorted(self.table, key=len)
        node = {"": 0} | {text: i for i, text in enumerate(ordered, 1)}
        known = [self.table[text] for text in ordered]
        self.gain = np.array([-np.inf, *[k[0] if k else -np.inf for k in known]])
        self.piece = np.array([0, *[k[1][0] if k else 0 for k in known]], np.int32)
        key = np.array([node[t[:-1]] << 21 | ord(t[-1]) for t in ordered], np.int64)
        bits = max(10, (8 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (key.view(np.uint64) * _FACTOR >> self.shift).view(np.int64)
        size = (1 << bits) + len(key) + 1
        self.keys, self.children = np.full(size, -1), np.zeros(size, np.int64)
        left, probes = np.arange(len(key)), 0
        while len(left):  # all that want a free slot: the first of them gets it, the others try the next
            at = slot[left] + probes
            free = np.flatnonzero(self.keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.keys[at[taken]] = key[left[taken]]
            self.children[at[taken]] = left[taken] + 1
            left, probes = np.delete(left, taken), probes + 1
        #: Nodes of single characters; the last entry, of no piece, is for characters beyond.
        self.first = np.zeros(max(map(ord, (t for t in ordered if len(t) == 1)), default=0) + 2, np.int64)
        for text in ordered:
            if len(text) == 1:
                self.first[ord(text)] = node[text]

    @classmethod
    def load(cls, name: str, folder: str | None = None) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name, folder))
        scored, bytes_ = [], {}
        for at in range(model.get_piece_size()):
            if model.is_byte(at):
                bytes_[int(model.id_to_piece(at)[1:-1], 16)] = at
            elif not (model.is_control(at) or model.is_unknown(at) or model.is_unused(at)):
                scored.append((model.id_to_piece(at), model.get_score(at), at))
        return cls(scored, bytes_)

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", MARK)

    def links(self, marked: str) -> list[str]:
        """Cut where no piece crosses."""
        joined = self.joined
        cuts = [i for i, (a, b) in enumerate(zip(marked, marked[1:]), 1) if a + b not in joined]
        if not cuts:
            return [marked] if marked else []
        return [marked[i:j] for i, j in zip([0, *cuts], [*cuts, len(marked)])]

    def links_of(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """The links of many words, one after another, and the place of each word's first."""
        text = "".join(words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        begins = np.cumsum([0, *map(len, words)])
        cut = np.ones(len(codes) + 1, bool)
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), max(len(self.pairs) - 1, 0))
        cut[1:-1] = self.pairs[at] != pairs if len(self.pairs) else True
        cut[begins] = True
        places = np.flatnonzero(cut)
        first = np.searchsorted(places, begins[:-1])
        places = places.tolist()
        return first, [text[i:j] for i, j in zip(places, places[1:])]

    def _next(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Nodes of the trie after one more character; -1 where no piece goes on so."""
        key = state << 21 | codes
        slot = (key.view(np.uint64) * _FACTOR >> self.shift).view(np.int64)
        there = self.keys[slot]
        hit, rows = there == key, np.arange(len(key))
        child = np.where(hit, self.children[slot], -1)
        other = np.flatnonzero((there >= 0) & ~hit)  # an empty place ends the search
        while len(other):
            slot = slot[other] + 1
            key, there = key[other], self.keys[slot]
            hit = there == key
            rows = rows[other]
            child[rows[hit]] = self.children[slot[hit]]
            other = np.flatnonzero((there >= 0) & ~hit)
        return child

    def best_many(self, links: list[str]) -> Iterator[tuple]:
        """``best`` of many links at once: (places in ``links``, scores, bounds, numbers of ids, ids) in parts."""
        sizes = np.fromiter(map(len, links), np.int64, len(links))
        text = np.frombuffer("".join(links).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        first, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            size = int(sizes[same[0]])
            rows = 1 if size > LONGEST else max(1, TOGETHER // size)
            for at in range(0, len(same), rows):
                part = same[at: at + rows]
                codes = text[first[part][:, None] + np.arange(size)]
                alone = self.first[np.minimum(codes, len(self.first) - 1)]
                plain = np.isfinite(self.gain[alone]).all(axis=1)
                if size > LONGEST:
                    plain[:] = False
                for i in part[~plain].tolist():  # bytes in it, or long: one by one
                    top, ids, low = self.best(links[i])
                    yield np.array([i]), np.array([top]), np.array([low]), np.array([len(ids)]), np.array(ids, np.int32)
                if plain.any():
                    yield part[plain], *self._viterbi(codes[plain])

    def _viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass over links of equal length, all characters pieces."""
        m, n = codes.shape
        best, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        back, piece = np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int32)
        best[0] = 0.0
        for i in range(n):
            rows, state = np.arange(m), self.first[codes[:, i]]
            for j in range(i + 1, n + 1):
                if j > i + 1:
                    state = self._next(state, codes[rows, j - 1])
                    alive = np.flatnonzero(state >= 0)
                    if len(alive) < len(rows):
                        rows, state = rows[alive], state[alive]
                    if not len(rows):
                        break
                gain = self.gain[state]
                whole = np.flatnonzero(gain > -np.inf)
                if len(whole) < len(rows):
                    r, gain = rows[whole], gain[whole]
                else:
                    r = rows
                value, old = best[i, r] + gain, best[j, r]
                second[j, r] = np.maximum(second[j, r], np.minimum(old, value))
                best[j, r] = np.maximum(old, value)
                up = np.flatnonzero(value > old)
                back[j, r[up]] = i
                piece[j, r[up]] = self.piece[state[whole[up]]]
        ids, count = np.zeros((m, n), np.int32), np.zeros(m, np.int64)
        rows, at = np.arange(m), np.full(m, n)
        while len(rows):
            count[rows] += 1
            ids[rows, n - count[rows]] = piece[at, rows]
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        return best[n], (best[1:] - second[1:]).min(axis=0), count, ids[np.arange(n) >= n - count[:, None]]

    def spelled(self, char: str) -> tuple[float, tuple[int, ...]] | None:
        """A character that is no piece, by its bytes."""
        raw = char.encode("utf-8", "surrogatepass")
        if any(b not in self.bytes for b in raw):
            return None
        return self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)

    def lattice(self, link: str) -> tuple[list[float], list[list[tuple[int, float, tuple]]]]:
        """Best prefix scores, and for each place the pieces (begin, score, ids) ending there."""
        n = len(link)
        best = [0.0] + [-np.inf] * n
        ending: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            base, single = best[i], False
            j = i + 1
            while j <= n:
                known = self.table.get(link[i:j], False)
                if known is False:
                    break
                if known is not None:
                    single |= j == i + 1
                    ending[j].append((i, known[0], known[1]))
                    best[j] = max(best[j], base + known[0])
                j += 1
            if not single and (known := self.spelled(link[i])):
                ending[i + 1].append((i, known[0], known[1]))
                best[i + 1] = max(best[i + 1], base + known[0])
        return best, ending

    def best(self, link: str) -> tuple[float, tuple[int, ...], float]:
        """The best segmentation's score and ids, and a lower bound of the next one's loss."""
        table, n = self.table, len(link)
        low = -np.inf
        best, second = [0.0] + [low] * n, [low] * (n + 1)
        back: list = [None] * (n + 1)
        for i in range(n):
            base, single = best[i], False
            for j in range(i + 1, n + 1):
                known = table.get(link[i:j], False)
                if known is False:
                    break
                if known is not None:
                    if j == i + 1:
                        single = True
                    value = base + known[0]
                    if value > best[j]:
                        second[j], best[j], back[j] = best[j], value, (i, known[1])
                    elif value > second[j]:
                        second[j] = value
            if not single and (known := self.spelled(link[i])):
                value = base + known[0]
                if value > best[i + 1]:
                    second[i + 1], best[i + 1], back[i + 1] = best[i + 1], value, (i, known[1])
                elif value > second[i + 1]:
                    second[i + 1] = value
        ids: list[tuple] = []
        j = n
        while j:
            ids.append(back[j][1])
            j = back[j][0]
        bound = min([a - b for a, b in zip(best[1:], second[1:])])
        return best[n], tuple(i for part in reversed(ids) for i in part), bound

    def n_best(self, link: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations (score, ids): backward A* over the lattice."""
        score, ending = self.lattice(link)
        # a suffix is (ids of its first piece, the rest of it), so long links cost no copies
        queue: list[tuple] = [(0.0, len(link), 0, None)]
        found: list[tuple[float, tuple[int, ...]]] = []
        pushed = 0
        while queue and len(found) < n:
            lost, at, _, suffix = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while suffix is not None:
                    ids += suffix[0]
                    suffix = suffix[1]
                found.append((score[-1] - lost, tuple(ids)))
                continue
            for begin, gain, piece in ending[at]:
                loss = score[at] - (score[begin] + gain)
                pushed += 1
                heapq.heappush(queue, (lost + loss, begin, pushed, (piece, suffix)))
        return found

    def decode(self, ids: list[int] | tuple[int, ...]) -> str:
        """Text of ids: byte pieces join to UTF-8, marks become spaces, the leading one goes."""
        plain = self.plain
        try:
            text = "".join([plain[at] for at in ids])
        except KeyError:
            out = b"".join([
                bytes([self.byte_of[at]]) if at in self.byte_of else self.text[at].encode()
                for at in ids])
            text = out.decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    @cached_property
    def spelling(self) -> tuple[pa.Array, np.ndarray]:
        """The bytes of each id, marks as spaces, and which ids are bytes beyond ASCII."""
        last = max([*self.text, *self.byte_of], default=-1)
        raw = [self.text[at].replace(MARK, " ").encode("utf-8", "surrogatepass") if at in self.text
               else bytes([self.byte_of[at]]) if at in self.byte_of else None for at in range(last + 1)]
        high = np.array([at not in self.text and self.byte_of.get(at, 0) > 127 for at in range(last + 1)], bool)
        return pa.array(raw, pa.binary()), high

    def texts(self, lists: pa.ListArray) -> Iterator[bytes]:
        """``decode`` of a column of lists, in UTF-8; a null list is an empty text."""
        raw, high = self.spelling
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], lists.type)
        for at in range(0, len(lists), _ROWS):
            part = lists.slice(at, _ROWS)
            flat, sizes = part.flatten(), part.value_lengths().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            bytes_before = np.concatenate([[0], np.cumsum(high[flat.to_numpy(zero_copy_only=False)])])
            joined = pc.binary_join(pa.ListArray.from_arrays(
                pa.array(ends.astype(np.int32)), raw.take(flat)), b"").to_pylist()
            for i, text in enumerate(joined):
                if bytes_before[ends[i + 1]] > bytes_before[ends[i]]:
                    ids = flat.slice(int(ends[i]), int(sizes[i])).to_pylist()
                    yield self.decode(ids).encode("utf-8", "surrogatepass")
                else:
                    yield text[1:] if self.dummy_prefix and text.startswith(b" ") else text


class _Numbers(dict):
    """Numbers strings in the order in which they are first looked up."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        number = self[key] = len(self)
        return number

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))

    def taken(self) -> list[str]:
        """Those numbered since the last call."""
        fresh, self.fresh = self.fresh, []
        return fresh


class _Grown:
    """A numpy column that grows."""

    def __init__(self, kind) -> None:
        self.data, self.n = np.empty(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            bigger = np.empty(2 * need, self.data.dtype)
            bigger[: self.n] = self.data[: self.n]
            self.data = bigger
        self.data[self.n: need] = values
        self.n = need


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each (start, count), one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Whole texts by cached links; new links of many texts are solved together."""

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.pieces, self.n = pieces, n
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if pieces.spaced else None
        self._forget_links()

    def _forget_words(self) -> None:
        self.words = _Numbers()
        self.word_start, self.word_links = _Grown(np.int64), _Grown(np.int64)
        self.parts = _Grown(np.int64)  # the links of all words

    def _forget_links(self) -> None:
        self._forget_words()
        self.links = _Numbers()
        self.names: list[str] = []
        self.score, self.bound = _Grown(float), _Grown(float)
        self.start, self.size, self.ids_of = _Grown(np.int64), _Grown(np.int64), _Grown(np.int32)
        self.lists: dict[int, list] = {}

    def _learn(self, words: list[str]) -> None:
        """Keep the links of new words, and solve those links that are new."""
        first, parts = self.pieces.links_of(words)
        self.word_start.add(self.parts.n + first)
        self.word_links.add(np.diff(np.append(first, len(parts))))
        self.parts.add(self.links.of(parts))
        new = self.links.taken()
        self.names += new
        score, bound = np.empty(len(new)), np.empty(len(new))
        start, size = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        for at, scores, bounds, sizes, ids in self.pieces.best_many(new):
            score[at], bound[at], size[at] = scores, bounds, sizes
            start[at] = self.ids_of.n + np.cumsum(sizes) - sizes
            self.ids_of.add(ids)
        for column, values in ((self.score, score), (self.bound, bound), (self.start, start), (self.size, size)):
            column.add(values)

    def solve(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's links. They hold until the next call."""
        if len(self.names) > CACHED_LINKS:
            self._forget_links()
        elif len(self.words) > CACHED:
            self._forget_words()
        marked = [self.pieces.normalise(t) for t in texts]
        words = [self.words.of(self.cut.findall(m) if self.cut else [m] * bool(m)) for m in marked]
        if new := self.words.taken():
            self._learn(new)
        start, count, parts = self.word_start.data, self.word_links.data, self.parts.data
        return [parts[_ranges(start[at], count[at])] for at in words]

    def _alternatives(self, link: int) -> list[tuple[float, tuple[int, ...]]]:
        known = self.lists.get(link)
        if known is None:
            if len(self.lists) >= CACHED_LISTS:
                self.lists.clear()
            known = self.lists[link] = self.pieces.n_best(self.names[link], self.n)
        return known

    def _least(self, links: np.ndarray) -> list[tuple[int, list]]:
        """The links that can take part: (place, alternatives), at most n - 1."""
        bounds = self.bound.data[links]
        places = np.flatnonzero(np.isfinite(bounds))
        order = places[np.argsort(bounds[places], kind="stable")]
        most, chosen = self.n - 1, []
        for at, bound, link in zip(order.tolist(), bounds[order].tolist(), links[order].tolist()):
            if len(chosen) == most and bound > chosen[-1][0]:
                break
            options = self._alternatives(link)
            if len(options) > 1:
                insort(chosen, (options[0][0] - options[1][0], at, options))
                del chosen[most:]
        return sorted((at, options) for _, at, options in chosen)

    def listed(self, links: np.ndarray) -> tuple[float, list[tuple[float, tuple]]]:
        """Best score, and the n best as (score, ((place of a link, option), ...))."""
        total = float(self.score.data[links].sum())
        places = self._least(links) if self.n > 1 else []
        # A* over the chain of the chosen links, backward; a link's best is its heuristic
        queue: list[tuple] = [(0.0, len(places), ())]
        found: list[tuple[float, tuple]] = []
        while queue and len(found) < self.n:
            loss, at, picks = heapq.heappop(queue)
            if at == 0:
                found.append((total - loss, tuple((places[i][0], p) for i, p in enumerate(picks) if p)))
                continue
            options = places[at - 1][1]
            for p, (score, _) in enumerate(options):
                heapq.heappush(queue, (loss + options[0][0] - score, at - 1, (p, *picks)))
        return total, found

    def spelled(self, links: np.ndarray, picks: list[tuple]) -> list[np.ndarray]:
        """Ids of some of the n best, by their picks; links without one keep their best."""
        sizes = self.size.data[links]
        best = self.ids_of.data[_ranges(self.start.data[links], sizes)]
        ends = np.cumsum(sizes)
        out = []
        for chosen in picks:
            pieces, at = [], 0
            for place, option in chosen:
                end = int(ends[place])
                pieces += [best[at: end - int(sizes[place])],
                           np.array(self._alternatives(int(links[place]))[option][1], np.int32)]
                at = end
            out.append(np.concatenate([*pieces, best[at:]]) if pieces else best)
        return out

    def encode(self, text: str) -> tuple[float, bytes, list[tuple[float, tuple]]]:
        """Best score, its raw ids, and the n best as (score, picks) of one text."""
        links = self.solve([text])[0]
        total, found = self.listed(links)
        return total, self.spelled(links, [()])[0].tobytes(), found

    def ids(self, text: str, picks: tuple) -> list[int]:
        """Ids of one of the n best of ``text``."""
        return self.spelled(self.solve([text])[0], [picks])[0].tolist()


@cache
def _pieces(model: str, folder: str | None) -> Pieces:
    return Pieces.load(model, folder)


def _text_digest(text: str) -> str:
    return sha256(text.replace(MARK, " ").encode("utf-8", "surrogatepass")).hexdigest()


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``BLOCK_CHARS`` characters; a longer text is one of its own."""
    at = 0
    while at < len(texts):
        to, chars = at + 1, len(texts[at])
        while to < len(texts) and chars + len(texts[to]) <= BLOCK_CHARS:
            chars, to = chars + len(texts[to]), to + 1
        yield at, to
        at = to


def _lists(arrays: list[np.ndarray], kind=np.int32) -> pa.ListArray:
    """A list column of numpy arrays."""
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, kind)])))


def _encoded(batches: Iterator[pa.RecordBatch], model: str, folder: str | None, n: int) -> Iterator[pa.RecordBatch]:
    """``encode`` of batches of (doc_id, text), a block of texts at a time.

    The links' caches end with the task: Spark hands its worker on to other work, which would hold
    them, and what Arrow keeps free, beside its own memory.
    """
    tool = Encoder(_pieces(model, folder), n)
    for batch in batches:
        texts = batch.column(1).fill_null("").to_pylist()
        for at, to in _blocks(texts):
            scores, counts, best, listed, values = [], [], [], [], []
            for links in tool.solve(texts[at:to]):
                total, found = tool.listed(links)
                spelled = tool.spelled(links, [picks for _, picks in found])
                scores.append(total)
                best.append(spelled[0])
                counts.append(len(found))
                listed += spelled
                values += [float(score) for score, _ in found]
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            n_best = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                [pa.array(values, pa.float64()), _lists(listed)], names=["score", "ids"]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(at, to - at), _lists(best), pa.array(scores, pa.float64()), n_best,
                pa.array([_text_digest(t) for t in texts[at:to]])],
                names=["doc_id", "ids", "score", "n_best", "text_sha256"])
    del tool
    pa.default_memory_pool().release_unused()


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None,
           n: int = 4) -> DataFrame:
    """(doc_id, ids, score, n_best, text_sha256) of every document; n_best lists (score, ids), best
    first; the digest is of the text that decoding should give (marks as spaces)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _encoded(batches, model, folder, n), "doc_id long, ids array<int>, score double, "
             "n_best array<struct<score: double, ids: array<int>>>, text_sha256 string")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model",
           folder: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, folder)
        for batch in batches:
            texts = pieces.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())],
                names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def segmentations(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None,
                  n: int = 4) -> DataFrame:
    """A row per document: doc_id, n_pieces, ids_crc32 (of the best ids as little-endian 32-bit
    numbers), score, n_best_scores, n_best_ids (the ids of all of them), round_trip.

    ``round_trip``: decoding each of the encoded rows' lists of ids gives the text (with marks as
    spaces) back. Encoding and decoding run one after the other in a task, a block of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model, folder)
        for batch in _encoded(batches, model, folder, n):
            docs, best, scores, listed, digests = batch.columns
            all_ids = listed.flatten().field("ids")
            sizes, owner = best.value_lengths(), listed.value_lengths()
            good = np.ones(batch.num_rows, bool)
            row = np.repeat(np.arange(batch.num_rows), owner.to_numpy())
            wanted = digests.to_pylist()
            for i, text in zip(row.tolist(), pieces.texts(all_ids)):
                good[i] &= sha256(text).hexdigest() == wanted[i]
            ends = np.concatenate([[0], np.cumsum(sizes.to_numpy())])
            raw = best.flatten().to_numpy(zero_copy_only=False).astype(_KIND)
            crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            counts = pa.array(np.concatenate([[0], np.cumsum(owner.to_numpy())]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                docs, sizes.cast(pa.int64()), pa.array(crcs, pa.int64()), scores,
                pa.ListArray.from_arrays(counts, listed.flatten().field("score")),
                pa.ListArray.from_arrays(counts, all_ids), pa.array(good)],
                names=["doc_id", "n_pieces", "ids_crc32", "score", "n_best_scores", "n_best_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, score double, n_best_scores array<double>, "
             "n_best_ids array<array<int>>, round_trip boolean")
