"""SentencePiece encoding and decoding with source offsets.

Reads a BPE model with byte fallback. Texts are normalised by the longest prefix found in the model's compiled character map
(a character without an entry stands for itself), and each normalised character remembers the source byte where it came
from. Pieces are then merged by score within stretches that no piece can cross, and every piece is projected to the byte span
of the source that it stands for. Decoding turns ids back into text as the library does.

Cases: null text counts as empty and encodes to the end id alone; very long stretches without a space are merged with a heap;
repeated rows give repeated results; other columns than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyform.llm.shared import grown

SPACE = "▁"
#: Stretches, and ids of stretches, that a Python worker keeps before it begins anew.
CACHED, CACHED_IDS = 250_000, 4_000_000
#: Longer stretches are merged one by one, with a heap.
TOGETHER_CHARS = 48
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def read_character_map(blob: bytes) -> dict[bytes, str]:
    """Entries of a compiled character map: a double-array trie of byte strings, and the texts that its leaves point to."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, texts = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :]
    jump = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    found: dict[bytes, str] = {}
    todo = [(jump(units[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or units[at] & 0x800000FF != c:
                continue
            below, key = at ^ jump(units[at]), prefix + bytes([c])
            if units[at] >> 8 & 1:
                start = units[below] & 0x7FFFFFFF
                found[key] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((below, key))
    return found


class Normalizer:
    def __init__(self, entries: dict[bytes, str], add_dummy_prefix: bool = True, remove_extra_whitespaces: bool = False):
        self.entries, self.dummy, self.squeeze = entries, add_dummy_prefix, remove_extra_whitespaces
        self.longest = max(map(len, entries), default=0)
        self.plain = not entries and not remove_extra_whitespaces

    def _prefixes(self, raw: bytes) -> Iterator[tuple[str, int, int]]:
        """(normalised text, first source byte, byte behind it) of the longest known prefix, again and again."""
        at = 0
        while at < len(raw):
            for n in range(min(self.longest, len(raw) - at), 0, -1):
                if (hit := self.entries.get(raw[at : at + n])) is not None:
                    yield hit, at, at + n
                    at += n
                    break
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                yield raw[at : at + n].decode(errors="replace"), at, at + n
                at += n

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """The normalised text, and for each of its characters, and its end, the source byte where it begins."""
        raw = text.encode()
        out: list[str] = []
        source: list[int] = []
        end = len(raw)
        for piece, at, _ in self._prefixes(raw):
            for c in piece:
                if self.squeeze and c == " " and (not out or out[-1] == " "):
                    continue
                out.append(c)
                source.append(at)
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            end = source.pop()
        if out and self.dummy:
            out.insert(0, " ")
            source.insert(0, source[0])
        return "".join(out).replace(" ", SPACE), [*source, end if out else 0]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """As calling it. Where every character stands for itself, bytes that begin one are all there is to find."""
        if not self.plain:
            shown, source = self(text)
            return shown, np.array(source, dtype=np.int64)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        front = [0] if self.dummy and len(raw) else []
        shown = (SPACE + text if front else text).replace(" ", SPACE)
        return shown, np.concatenate([front, np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]]).astype(np.int64)


class PairTable:
    """Pairs of symbols that merge, for numpy lookups: each pair sits in the first of three tables where its place was free."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.levels = []
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        for bits in (20, 18, 16, 14, 12, 10, 8, 6, 4, 2):
            keys, values = np.full(1 << bits, 2**64 - 1, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int64)
            place = self._place(key, bits)
            _, first = np.unique(place, return_index=True)
            keys[place[first]], values[place[first]] = key[first], merged[first]
            self.levels.append((bits, keys, values))
            rest = np.ones(len(key), dtype=bool)
            rest[first] = False
            key, merged = key[rest], merged[rest]
            if not len(key):
                break
        if len(key):
            raise ValueError("pairs do not fit their tables")

    @staticmethod
    def _place(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(bits)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair merges to, -1 where there is none."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out = np.full(len(key), -1, dtype=np.int64)
        for bits, keys, values in self.levels:
            place = self._place(key, bits)
            hit = keys[place] == key
            out[hit] = values[place[hit]]
        return out


class Pieces:
    """A model: pieces with ids and scores, the normaliser, and the cache of stretches."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix or not model.normalizer_spec.escape_whitespaces:
            raise ValueError("a BPE model with byte fallback and escaped, leading white space is needed")
        if any(p.type in (_USER, _UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        spec = model.normalizer_spec
        self.normalizer = Normalizer(read_character_map(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        self.texts = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.loss = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unseen = {i for i, p in enumerate(model.pieces) if p.type == _CONTROL}
        self.end = next((i for i, p in enumerate(model.pieces) if p.type == _CONTROL and p.piece == (model.trainer_spec.eos_piece or "</s>")), 2)
        # A stretch ends before a space that follows another character, and around a line feed, if no piece goes across.
        if any(a != SPACE and b == SPACE for t in self.ids for a, b in zip(t, t[1:], strict=False)):
            self.stretch = re.compile(r"(?s).+")
        elif any("\n" in t and len(t) > 1 for t in self.ids):
            self.stretch = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.stretch = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.words, self.shown = list(map(str, range(len(self.texts)))), [t.replace(SPACE, " ") for t in self.texts]
        #: Normalised characters of each piece.
        self.width = np.array([len(t) for t in self.texts], dtype=np.int64)
        # control ids show nothing, and a byte below 128 is a character wherever it stands; other bytes depend on their neighbours
        for i in self.unseen:
            self.shown[i] = ""
        for b in range(128):
            self.shown[self.byte_ids[b]] = chr(b)
        self.apart = np.array([self.byte_of.get(i, 0) >= 128 for i in range(len(self.texts))])
        self._forget()
        pairs = [(self.ids[t[:k]], self.ids[t[k:]], i) for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        self.pairs = PairTable(*np.array(pairs, dtype=np.int64).reshape(-1, 3).T)
        by_loss = sorted(self.ids.values(), key=lambda i: self.loss[self.texts[i]])
        losses = np.array([self.loss[self.texts[i]] for i in by_loss])
        self.rank = np.full(len(self.texts) + 1, len(self.texts), dtype=np.int64)  # the last place is for pairs that do not merge
        self.rank[by_loss] = np.cumsum(np.diff(losses, prepend=losses[:1]) != 0)

    def merge(self, stretch: str) -> list[str]:
        """Pieces of a stretch: the adjacent pair of best score is merged, the leftmost of equals, until none is known."""
        parts = list(stretch)
        loss, none = self.loss, float("inf")
        if len(parts) > 48:
            return self._merge_long(parts)
        pairs = [loss.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = loss.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = loss.get(parts[i] + parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (known := self.loss.get(parts[i] + parts[j])) is not None:
                heapq.heappush(waiting, (known, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right or not left:
                continue
            parts[i], parts[j] = left + right, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def _forget(self) -> None:
        #: Stretches met so far: where their ids, and the characters of each id, stand in ``ids`` and ``widths``.
        self.known: dict[str, int] = {}
        self.ids_of, self.widths_of, self.begin, self.size = (np.zeros(1 << 16, dtype=np.int64) for _ in range(4))
        self.used = 0

    def _remember(self, stretches: list[str], ids: np.ndarray, widths: np.ndarray, size: np.ndarray) -> None:
        k, n, more = len(self.known), self.used, len(ids)
        self.ids_of, self.widths_of = grown(self.ids_of, n + more), grown(self.widths_of, n + more)
        self.begin, self.size = grown(self.begin, k + len(size)), grown(self.size, k + len(size))
        self.ids_of[n : n + more], self.widths_of[n : n + more] = ids, widths
        self.begin[k : k + len(size)], self.size[k : k + len(size)] = n + np.cumsum(size) - size, size
        self.used += more
        self.known.update(zip(stretches, range(k, k + len(stretches)), strict=True))

    def _encode_one(self, stretch: str) -> tuple[list[int], list[int]]:
        """Ids, and normalised characters of each: a character in several byte ids counts with the first."""
        ids: list[int] = []
        widths: list[int] = []
        for part in self.merge(stretch):
            if (i := self.ids.get(part)) is not None:
                ids.append(i)
                widths.append(len(part))
            else:
                raw = part.encode()
                ids += [self.byte_ids[b] for b in raw]
                widths += [len(part)] + [0] * (len(raw) - 1)
        return ids, widths

    def _encode_singly(self, stretches: list[str]) -> None:
        if found := [self._encode_one(s) for s in stretches]:
            flat = [np.array([x for pair in found for x in pair[k]], dtype=np.int64) for k in (0, 1)]
            self._remember(stretches, *flat, np.array([len(ids) for ids, _ in found], dtype=np.int64))

    def _encode_together(self, stretches: list[str]) -> None:
        """Remember short stretches: in each round every stretch merges its best pair, all at once in numpy."""
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), dtype=np.uint32)
        kinds, back = np.unique(points, return_inverse=True)
        unknown = len(self.texts) + 1
        symbol = np.array([self.ids.get(chr(c), unknown) for c in kinds.tolist()], dtype=np.int64)[back]
        size = np.array([len(x) for x in stretches])
        owner = np.arange(len(stretches))
        heads = np.cumsum(size) - size
        none = len(self.texts)
        # ranks[i]: how good the merge of symbols i and i + 1 is, ``none`` if there is none, or they are of two stretches.
        ranks = np.full(len(symbol), none, dtype=np.int64)
        ranks[:-1] = self.rank[self.pairs(symbol[:-1], symbol[1:])]
        ranks[heads + size - 1] = none
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(owner):
            # rank and place in one number: the least is the best pair of a stretch, the leftmost of equals
            best = np.minimum.reduceat((ranks << 32) | np.arange(len(ranks)), heads)
            rank, hit = best >> 32, best & 0xFFFFFFFF
            over = rank == none
            if over.any():
                gone = np.repeat(over, size)
                done.append((symbol[gone], owner[over], size[over]))
                before = np.cumsum(np.where(over, size, 0))
                hit = (hit - before)[~over]
                symbol, ranks, owner, size = symbol[~gone], ranks[~gone], owner[~over], size[~over]
            symbol[hit] = self.pairs(symbol[hit], symbol[hit + 1])
            ranks[hit] = ranks[hit + 1]
            keep = np.ones(len(symbol), dtype=bool)
            keep[hit + 1] = False
            symbol, ranks = symbol[keep], ranks[keep]
            size = size - 1
            heads = np.cumsum(size) - size
            at = hit - np.arange(len(hit))
            left, right = at[at > heads] - 1, at[at < heads + size - 1]
            for pair in (left, right):  # only the pairs beside a merge are new
                ranks[pair] = self.rank[self.pairs(symbol[pair], symbol[pair + 1])]
        symbols = np.concatenate([x[0] for x in done])
        size, owner = np.concatenate([x[2] for x in done]), np.concatenate([x[1] for x in done])
        odd = np.zeros(len(stretches), dtype=bool)
        odd[owner] = np.add.reduceat(symbols == unknown, np.cumsum(size) - size) > 0
        plain = ~odd[owner]
        ids = symbols[np.repeat(plain, size)]
        self._remember([stretches[k] for k in owner[plain].tolist()], ids, self.width[ids], size[plain])
        self._encode_singly([stretches[k] for k in np.flatnonzero(odd).tolist()])

    def encode_all(self, normalised: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the normalised characters of each, and the number of ids of each text."""
        texts = [self.stretch.findall(t) for t in normalised]
        if len(self.known) > CACHED or self.used > CACHED_IDS:
            self._forget()
        known = self.known
        unseen = {s for t in texts for s in t if s not in known}
        if short := [s for s in unseen if len(s) <= TOGETHER_CHARS]:
            self._encode_together(short)
        self._encode_singly([s for s in unseen if len(s) > TOGETHER_CHARS])
        count = np.array([len(t) for t in texts], dtype=np.int64)
        place = np.fromiter((known[s] for t in texts for s in t), dtype=np.int64, count=int(count.sum()))
        size, ends = self.size[place], np.cumsum(self.size[place])
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[place] - ends + size, size)
        total = np.concatenate([[0], ends])[np.cumsum(count)]
        return self.ids_of[at], self.widths_of[at], np.diff(total, prepend=0)

    def encode_spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the byte of its source where each begins and the one behind it, and the number of ids of each
        text. A character in several byte ids gives each its own source byte, if it has as many; the front space has none."""
        aligned = [self.normalizer.aligned(t) for t in texts]
        ids, widths, count = self.encode_all([shown for shown, _ in aligned])
        first = np.concatenate([np.zeros(0, dtype=np.int64), *(source[:-1] for _, source in aligned)])
        behind = np.concatenate([np.zeros(0, dtype=np.int64), *(source[1:] for _, source in aligned)])
        if not len(ids):
            return ids, ids, ids, count
        # ids without a character of their own go with the one before them
        head = np.flatnonzero(widths)
        group = np.cumsum(widths > 0) - 1
        at = np.cumsum(widths[head]) - widths[head]
        start, stop = first[at], behind[at + widths[head] - 1]
        members = np.diff(np.append(head, len(ids)))
        own = (members > 1) & (stop - start == members)
        nth = np.arange(len(ids)) - head[group]
        starts = start[group] + np.where(own[group], nth, 0)
        return ids, starts, np.where(own[group], starts + 1, stop[group]), count

    def _decode(self, ids: list[int]) -> str:
        if not self.apart[ids].any():
            return "".join([self.shown[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            if i >= 0 and i not in self.unseen:
                out.append(self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control ids have none; the space that encoding put in front goes."""
        text = self._decode(ids)
        lead = next((i for i in ids if i not in self.unseen), None)
        return text[1:] if self.normalizer.dummy and lead is not None and self.texts[lead].startswith(SPACE) else text

    def encode(self, text: str | None) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids with the end id, and the byte span of the source for each; that of the end id is empty."""
        ids, starts, stops, _ = self.encode_spans([text or ""])
        end = len((text or "").encode())
        return [*ids.tolist(), self.end], [*zip(starts.tolist(), stops.tolist(), strict=True), (end, end)]


def _utf8(raw: bytes) -> str:
    """As the library decodes bytes: each byte that is not part of a character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        n = 1 if raw[at] < 0x80 else 2 if 0xC2 <= raw[at] < 0xE0 else 3 if 0xE0 <= raw[at] < 0xF0 else 4
        try:
            out.append(raw[at : at + n].decode())
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """The model at ``path``, read once by each worker."""
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def _coded(pieces: Pieces, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, starts and stops of each text, the end id and its empty span last."""
    ids, starts, stops, count = pieces.encode_spans(texts)
    at = 0
    for text, n in zip(texts, count.tolist(), strict=True):
        own, end = slice(at, at + n), len(text.encode())
        yield np.append(ids[own], pieces.end), np.append(starts[own], end), np.append(stops[own], end)
        at += n


def _runs(texts: list[str], chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in runs of bounded length; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and stop - at < 256 and size + len(texts[stop]) <= chars:
            size += len(texts[stop])
            stop += 1
        yield texts[at:stop]
        at = stop


def encode_documents(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, ids array<int> (the end id last), starts and stops array<int>: the byte span of the source of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            at = 0
            for texts in _runs([t or "" for t in batch[text_column].to_pylist()]):
                coded = list(_coded(pieces, texts))
                arrays = [pa.array([x[k] for x in coded], pa.list_(pa.int32())) for k in range(3)]
                yield pa.RecordBatch.from_arrays([batch[id_column].slice(at, len(texts)), *arrays], names=[id_column, "ids", "starts", "stops"])
                at += len(texts)

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, starts array<int>, stops array<int>")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (source bytes between the first piece's span and the last's
    end): all from the ids and spans that ``encode_documents`` gives, in the task that makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        words = pieces.words
        for batch in batches:
            rows: list[tuple[int, str, str, int]] = []
            for texts in _runs([t or "" for t in batch["text"].to_pylist()]):
                for ids, starts, stops in _coded(pieces, texts):
                    coded = ids.tolist()
                    rows.append((len(coded), _sha(" ".join([words[i] for i in coded])), _sha(pieces.decode(coded)), int(stops[-1] - starts[0])))
            n, ids, decoded, covered = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long")
