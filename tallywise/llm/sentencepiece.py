"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The public vocabulary at hand is a BPE one, whose encoding is not the best sum of piece scores but
the outcome of its merges.  The search is therefore over feasible segmentations: a piece may
follow another only if merging the two side by side would keep the cut between them.  A
segmentation all of whose neighbours agree in this way is exactly the merge result, so the ids
are those of the SentencePiece library.

Texts fall into chunks that no piece crosses (a space opens one; a character outside the vocabulary
is one, given as bytes).  A task encodes each distinct chunk once.  Hashes of the substrings of the
new chunks probe the sorted keys of pieces and of their beginnings, so that a substring grows only
while some piece begins with it.  Then all chunks advance together, position by position: the
feasible candidates that end there compete by a maximum, and the winner's length is the
backpointer.

A chunk longer than ``WINDOW`` bytes (text without spaces) is cut into overlapping windows, which
are rows like other chunks.  What ends at a position depends on the positions within the longest
piece before it alone, so where two windows agree on so many positions in their overlap, the
later one goes on as the whole chunk would; where they do not, the chunk is cut again into wider
windows, at last into one.  The work is linear in the length.  Chunks that open with several
spaces, whose pieces have tied scores, are merged one by one.

Null and empty texts have no ids.  As in the library, U+2581 is read as a space; otherwise
decoding gives the text back.  Ids outside the vocabulary are an error when decoding; control
ids and null lists decode to nothing.  Rows that repeat a doc_id are encoded each; other columns
stay behind; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywise.llm.common import mix, prefix_hashes, slices, span_hashes, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The library's sign for a space.
MARK = "▁"
#: Bytes of a window of a long chunk (32 times 15, so that windows of runs of few signs start alike), and of its overlap.
WINDOW, OVERLAP = 480, 120
#: Bytes of chunks that advance together.
BATCH = 1 << 18
_NEVER = np.int64(1 << 40)
_ID = (1 << 20) - 1


@dataclass
class Vocabulary:
    text: list[bytes]  # of each id; a space for the mark
    kind: np.ndarray  # 0 piece, 1 byte, 2 control or unknown
    score: np.ndarray
    bytes_at: np.ndarray  # id of each byte
    keys: np.ndarray  # sorted hashes of the pieces that merges can reach, and of their beginnings
    ids: np.ndarray  # -1 for a beginning that is no piece
    rank: np.ndarray  # when a piece comes about: 0 for characters
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray  # sorted left << 20 | right of the last merge of a piece
    pair_rank: np.ndarray
    longest: int

    def __post_init__(self) -> None:
        self.by_text = {t: i for i, t in enumerate(self.text) if self.kind[i] == 0}
        # where the keys with each upper 20 bits start, and the most that share them
        self.first = np.searchsorted(self.keys, np.arange((1 << 20) + 1, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
        self.first[-1] = len(self.keys)
        self.most = int(np.diff(self.first).max(initial=0))
        self.met, self.met_agree = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)
        self.sizes = np.array([len(t) for t in self.text])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        chars = [t for t in self.by_text if len(t.decode()) == 1]
        self.ascii = np.zeros(256, bool)
        self.ascii[[t[0] for t in chars if len(t) == 1]] = True
        self.wide = np.sort(np.array([int.from_bytes(t, "little") for t in chars if len(t) > 1], np.int64))

    def known(self, data: np.ndarray) -> np.ndarray:
        """Of each byte, whether its character is in the vocabulary."""
        out = self.ascii[data]
        head = np.flatnonzero(data >= 0xC0)
        lead = data[head]
        size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        code = lead.astype(np.int64)
        for k in (1, 2, 3):
            some = size > k
            code[some] |= data[head[some] + k].astype(np.int64) << (8 * k)
        at = np.minimum(np.searchsorted(self.wide, code), len(self.wide) - 1)
        fine = self.wide[at] == code
        for k in (0, 1, 2, 3):
            some = fine & (size > k)
            out[head[some] + k] = True
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes among the keys, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        top = (hashes >> np.uint64(44)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        open_ = np.flatnonzero(at < end)
        for _ in range(self.most):
            hit = self.keys[at[open_]] == hashes[open_]
            out[open_[hit]] = at[open_[hit]]
            at[open_] += 1
            open_ = open_[~hit & (at[open_] < end[open_])]
            if not len(open_):
                break
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``agree``, with the answers of earlier calls (of pairs that fall on one slot, the last one's)."""
        key = (a << 20) | b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(46)).astype(np.int64)
        out = self.met_agree[slot]
        new = np.flatnonzero(self.met[slot] != key)
        if len(new):
            out[new] = self.agree(a[new], b[new])
            self.met[slot[new]], self.met_agree[slot[new]] = key[new], out[new]
        return out

    def agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b, side by side, come out of the merges as these two.

        Undoes the later of the two merges in turn; a merge across the cut that would have come before what was undone
        (of equal ones, the left comes first) means that they don't.
        """
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), _NEVER)
        a, b = a.copy(), b.copy()
        while len(live):
            key = (a << 20) | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            across = np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)
            bad = across < limit
            out[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            undo_a = ra > rb
            go = ~bad & (undo_a | (rb > 0))
            limit = np.where(undo_a, ra, rb + 1)[go]
            a, b, live = np.where(undo_a, self.right[a], a)[go], np.where(undo_a, b, self.left[b])[go], live[go]
        return out

    def merged(self, chunk: bytes) -> list[int]:
        """The merges one by one: always the best score, of equal ones the leftmost."""
        parts: list[str | None] = list(chunk.decode())
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (whole := self.by_text.get((parts[i] + parts[j]).encode())) is not None:
                heapq.heappush(queue, (-self.score[whole], i, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, whole = heapq.heappop(queue)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j], after[i] = whole, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        out: list[int] = []
        for p in parts:
            if p is not None:
                i = self.by_text.get(p.encode())
                out += [i] if i is not None else self.bytes_at[list(p.encode())].tolist()
        return out


def load(path: str = MODEL) -> Vocabulary:
    """Reads the pieces and scores of a BPE model with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    kind = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in range(n)])
    names = [sp.id_to_piece(i) for i in range(n)]
    text = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(MARK, " ").encode() for p, k in zip(names, kind, strict=True)]
    score = np.array([sp.get_score(i) for i in range(n)])
    bytes_at = np.zeros(256, np.int64)
    for i in np.flatnonzero(kind == 1):
        bytes_at[text[i][0]] = i
    plain = {t.decode(): i for i, t in enumerate(text) if kind[i] == 0 and (len(t) == 1 or t.strip(b" "))}
    rank, left, right = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    reached = {t: i for t, i in plain.items() if len(t) == 1}
    for r, (t, i) in enumerate(sorted(((t, i) for t, i in plain.items() if len(t) > 1), key=lambda x: -score[x[1]]), 1):
        parts = list(t)
        while len(parts) > 2:  # merges of lower rank only: of those reached so far
            found = [(rank[reached[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in reached]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2 and all(p in reached for p in parts):
            rank[i], left[i], right[i] = r, reached[parts[0]], reached[parts[1]]
            reached[t] = i
    ids = np.array(sorted(reached.values()))
    begin = {text[i][:n]: -1 for i in ids for n in range(1, len(text[i]))} | {text[i]: int(i) for i in ids}
    blob = np.frombuffer(b"".join(begin), np.uint8)
    ends = np.cumsum([len(t) for t in begin])
    keys = span_hashes(blob, np.concatenate([[0], ends[:-1]]), ends)
    order = np.argsort(keys)
    made = ids[rank[ids] > 0]
    pairs = (left[made] << 20) | right[made]
    by_pair = np.argsort(pairs)
    return Vocabulary(text, kind, score, bytes_at, keys[order], np.array(list(begin.values()))[order], rank, left, right, pairs[by_pair], rank[made][by_pair], max(len(text[i]) for i in ids))


def viterbi(v: Vocabulary, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position of the spans: length << 20 | id of the piece that ends there, -1 where no segmentation ends.

    Also returns where each span's positions start (one more than its bytes; the first is -2).
    """
    base = np.cumsum(size + 1) - (size + 1)
    total = int(size.sum()) + len(size)
    inside = np.arange(total) - np.repeat(base, size + 1)
    left = np.repeat(size, size + 1) - inside  # bytes to the end of the span
    text = np.where(left > 0, data[np.minimum(np.repeat(starts, size + 1) + inside, len(data) - 1)], 0).astype(np.uint8)
    hashes = prefix_hashes(text)
    alive, found = np.flatnonzero(left), []
    for n in range(1, v.longest + 1):
        alive = alive[left[alive] >= n]
        at = v.find(hashes(alive, n))
        hit = at >= 0
        alive, ids = alive[hit], v.ids[at[hit]]
        whole = np.flatnonzero(ids >= 0)
        found.append((alive[whole], np.full(len(whole), n), ids[whole]))
    at, n, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    step = inside[at] + n
    order = np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")
    at, n, piece, step = at[order], n[order], piece[order], step[order]
    cuts = np.searchsorted(step, np.arange(1, int(size.max(initial=0)) + 2)).tolist()
    best = np.full(total, -1, np.int64)
    best[base] = -2
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        before = best[at[a:b]]
        ok = before != -1
        after = np.flatnonzero(before >= 0)
        ok[after] = v.fits(before[after] & _ID, piece[a:b][after])
        some = np.flatnonzero(ok) + a
        np.maximum.at(best, at[some] + n[some], (n[some] << 20) | piece[some])
    return best, base


def paths(best: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all spans in a row, from the backpointers, and the number of each span's."""
    here, live, met = ends.copy(), np.arange(len(ends)), []
    while True:
        live = live[best[here[live]] >= 0]
        if not len(live):
            break
        step = best[here[live]]
        met.append((live, step & _ID))
        here[live] -= step >> 20
    rows = np.concatenate([r for r, _ in met]) if met else np.zeros(0, np.int64)
    counts = np.bincount(rows, minlength=len(ends)).astype(np.int64)
    last = np.cumsum(counts) - 1
    ids = np.zeros(len(rows), np.int32)
    for k, (r, x) in enumerate(met):
        ids[last[r] - k] = x
    return ids, counts


def long_path(v: Vocabulary, chunk: np.ndarray) -> np.ndarray:
    """Ids of one long chunk, by windows; empty if no segmentation ends it."""
    total, heads = len(chunk), np.flatnonzero((chunk & 0xC0) != 0x80)
    state = np.full(total + 1, -1, np.int64)
    # states are those of the whole chunk up to ``known``, and a row from ``start`` gives the last of them
    start = known = after = 0
    count = BATCH // WINDOW
    while known < total:
        starts = after + WINDOW * np.arange(count)
        starts = np.unique(heads[np.searchsorted(heads, starts[starts < total]).clip(max=len(heads) - 1)])
        ends = np.minimum(starts + WINDOW + OVERLAP, total)
        best, base = viterbi(v, chunk, starts, ends - starts)
        fine = 0
        for s, e, at in zip(starts.tolist(), ends.tolist(), base.tolist(), strict=True):
            mine, shared = best[at : at + e - s + 1], known - s + 1
            differ = np.flatnonzero(mine[1:shared] != state[s + 1 : s + shared])
            alike = int(differ[-1]) + 2 if len(differ) else min(s, 1)
            if known == total or (s and shared - alike < v.longest):
                break
            state[s + alike : e + 1] = mine[alike:]
            start, known, fine = s, e, fine + 1
        count = 4 if fine < len(starts) else min(4 * count, BATCH // WINDOW)
        if not fine:
            further = min(start + 4 * (known - start), total)
            state[known + 1 : further + 1] = viterbi(v, chunk, np.array([start]), np.array([further - start]))[0][known - start + 1 :]
            known = further
        # the next windows begin where a piece ends, so that they fit in with runs of one sign too
        after = known
        while after > known - OVERLAP // 2 or state[after] < 0:
            after -= int(state[after] >> 20) if state[after] >= 0 else 1
    back, at, ids = state.tolist(), total, []
    while at and back[at] >= 0:
        ids.append(back[at] & _ID)
        at -= back[at] >> 20
    return np.array(ids[::-1], np.int32)


class Encoder:
    """Encodes slices of texts, with the ids of the chunks met so far."""

    def __init__(self, v: Vocabulary, most: int = 400_000) -> None:
        self.v, self.most = v, most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store, self.used = np.zeros(1 << 16, np.int32), 0

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stores the ids of distinct chunks; returns where they are."""
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        length = ends - starts
        slow = ~known[starts] | ((data[starts] == 32) & (length > 1) & (data[np.minimum(starts + 1, len(data) - 1)] == 32))
        lists: dict[int, Sequence[int]] = {}
        for i in np.flatnonzero(slow):
            part = data[starts[i] : ends[i]]
            lists[i] = self.v.merged(part.tobytes()) if known[starts[i]] else self.v.bytes_at[part].tolist()
        for i in np.flatnonzero(~slow & (length > WINDOW)):
            part = data[starts[i] : ends[i]]
            found = long_path(self.v, part)
            lists[i] = found if len(found) else self.v.merged(part.tobytes())
        every = np.flatnonzero(~slow & (length <= WINDOW))
        for usual in np.split(every, np.flatnonzero(np.diff(np.cumsum(length[every]) // BATCH)) + 1):
            best, base = viterbi(self.v, data, starts[usual], length[usual])
            last = base + length[usual]
            for i in usual[best[last] < 0]:
                lists[i] = self.v.merged(data[starts[i] : ends[i]].tobytes())
            good = best[last] >= 0
            ids, counts = paths(best, last[good])
            self._grow(len(ids))
            self.store[self.used : self.used + len(ids)] = ids
            at[usual[good]], size[usual[good]] = self.used + np.cumsum(counts) - counts, counts
            self.used += len(ids)
        for i, ids_ in lists.items():
            self._grow(len(ids_))
            self.store[self.used : self.used + len(ids_)] = ids_
            at[i], size[i] = self.used, len(ids_)
            self.used += len(ids_)
        return at, size

    def _grow(self, n: int) -> None:
        if self.used + n > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(max(n, len(self.store)), np.int32)])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each text start."""
        data, bounds = utf8(pc.replace_substring(text, MARK, " "))
        filled = np.flatnonzero(np.diff(bounds) > 0)
        data = np.insert(data, bounds[filled], 32)
        bounds = bounds + np.concatenate([[0], np.cumsum(np.diff(bounds) > 0)])
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        known = self.v.known(data)
        space = data == 32
        opens = ~known
        opens[1:] |= ~known[:-1] | (space[1:] & ~space[:-1])
        opens[bounds[:-1][bounds[:-1] < len(data)]] = True
        starts = np.flatnonzero(opens & ((data & 0xC0) != 0x80))
        ends = np.append(starts[1:], len(data))
        distinct, first, index = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, distinct)
        old = np.zeros(len(distinct), bool)
        inside = where < len(self.keys)
        old[inside] = self.keys[where[inside]] == distinct[inside]
        if not old.all():
            at, size = self._new(data, starts[first[~old]], ends[first[~old]], known)
            self.at, self.size = np.insert(self.at, where[~old], at), np.insert(self.size, where[~old], size)
            self.keys = np.insert(self.keys, where[~old], distinct[~old])
            where = np.searchsorted(self.keys, distinct)
        at, size = self.at[where][index], self.size[where][index]
        to = np.cumsum(size)
        ids = self.store[np.repeat(at - (to - size), size) + np.arange(to[-1])]
        if len(self.keys) > self.most:
            self._forget()
        return ids, np.append(0, to)[np.searchsorted(starts, bounds)]


def decoded(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that lists of ids stand for, and where those of each list start; the space before each text is off."""
    size = v.sizes[ids]
    to = np.cumsum(size)
    data = v.blob[np.repeat(v.starts[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
    cut = np.append(0, to)[bounds]
    filled = np.flatnonzero(np.diff(cut) > 0)
    off = filled[data[cut[filled]] == 32]
    gone = np.zeros(len(cut), np.int64)
    gone[off + 1] = 1
    return np.delete(data, cut[off]), cut - np.cumsum(gone)


def decode_ids(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of lists of ids; bytes that are no UTF-8 become U+FFFD."""
    data, cut = decoded(v, ids, bounds)
    raw, cut = data.tobytes(), cut.tolist()
    return [raw[a:b].decode(errors="replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]


def verified(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """SHA-256 of what each list decodes to, and whether that is the text."""
    data, cut = decoded(v, ids, bounds)
    own, at = utf8(text)
    same = np.diff(cut) == np.diff(at)
    if same.all():
        same &= np.diff(np.append(0, np.cumsum(data != own))[at]) == 0
    else:
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(data[cut[i] : cut[i + 1]], own[at[i] : at[i + 1]])
    raw, to = data.tobytes(), cut.tolist()
    parts = (raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True))
    return [hashlib.sha256(p if ok else p.decode(errors="replace").encode()).hexdigest() for p, ok in zip(parts, same.tolist(), strict=True)], same


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL, check: bool = False) -> DataFrame:
    """doc_id, n_tokens, tokens of every row; with ``check`` also what the tokens decode to: its digest, and if it is the text."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, bounds = encoder.encode(part.column("text"))
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(bounds)), "tokens": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))}
                if check:
                    digests, exact = verified(model.value, ids, bounds, part.column("text"))
                    columns["decoded_sha256"], columns["exact"] = pa.array(digests, pa.string()), pa.array(exact)
                yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, tokens array<int>" + ", decoded_sha256 string, exact boolean" * check)


def decode(encoded: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", model_path: str = MODEL) -> DataFrame:
    """doc_id and the text of each list of ids."""
    model = encoded.sparkSession.sparkContext.broadcast(load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.fill_null(batch.column("tokens"), pa.scalar([], batch.column("tokens").type))
            bounds = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(decode_ids(model.value, ids, bounds - bounds[0]), pa.string())})

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id long, text string")
