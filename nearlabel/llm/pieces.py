"""Exact tokenization of many texts through a memo of pieces, with the `tokenizers` library's own model.

A text is cut at *safe boundaries*: a space whose left neighbour is no white space. No pre-token of the supported
tokenizers spans such a place (byte-level BPE attaches the space to the right piece; the word-end BPE drops it), and no
special string holds a space, so the ids of a text are the ids of its pieces, one after another. Distinct pieces of a
batch are found by Arrow's dictionary encoding and encoded once; a bounded memo carries pieces over to later batches. Batches are balanced by bytes, and a long text is cut at safe boundaries over several batches, so working
memory does not follow the longest text.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from nearlabel.llm import KEPT

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text that are worked on at once, and entries of the memo; both bound a worker's memory.
BATCH_BYTES = 4 << 20
MEMO_ENTRIES = 500_000
WORD_ENTRIES = 400_000

_UNSAFE = re.compile(r"\s ").search
#: The same for Arrow, whose white space is ASCII's alone.
_UNSAFE_ARROW = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_SAFE_CUT = re.compile(r"(?<=\S) ")
#: Stands between pieces that are searched for pre-tokens together, a pre-token by itself there; pieces that may hold it
#: or a special string, end in white space, are empty, or have characters beyond Latin letters are odd.
_MARK = "\x00"
#: Pieces of Latin letters alone, each of which is one pre-token.
_LETTERS = {"byte": r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+\z", "word": r"^[A-Za-z]+\z"}
_ODD = r"[^\x01-\x{24F}]|<\||[\s\x0b\x1c-\x1f\x{85}\x{a0}]\z|^\z"


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte: printable Latin-1 stays, the others follow from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Null counts as the empty text. Supported directly: byte-level BPE without normalizer, and BPE with word ends after
    NFC, one-space and lower-case normalizers. Any other .json goes through ``encode_batch``, .model through
    sentencepiece, whole texts both.
    """

    def __init__(self, path: str):
        self.path = path
        self.memo = pa.array([], pa.large_string())
        self.memo_n = np.zeros(0, np.int64)
        self.words: dict[str, bytes] = {}
        self.kind = "other"
        if path.endswith(".model"):
            import sentencepiece

            self.kind, self.sp = "sentencepiece", sentencepiece.SentencePieceProcessor(model_file=path)
            self.dtype = np.uint32
            return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.memo_ids = np.zeros(0, self.dtype)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        plain = all("<|" in s for s in self.specials) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] for x in spec["added_tokens"])
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        if not plain or spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
            return
        import regex

        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            import public_tokenizers

            self.kind, self.find = "byte", regex.compile(public_tokenizers.PATTERN).findall
        elif norm and norm.get("type") == "Sequence" and [x["type"] for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            first, second = pre["pretokenizers"]
            if first["type"] == "Split" and first["invert"] and first["behavior"] == "Removed" and second["type"] == "ByteLevel":
                self.kind, self.find = "word", regex.compile(first["pattern"]["Regex"]).findall
        self.chars = _byte_chars()
        self.codes = np.array([ord(self.chars[b]) for b in range(256)], "<u4")

    def _word(self, pre: str) -> bytes:
        """Ids of one pre-token, by the library's model, as machine integers."""
        got = self.words.get(pre)
        if got is None:
            tail = pre[1:]
            if tail.isascii() and tail.isalnum() and pre[0] in " abcdefghijklmnopqrstuvwxyz":
                mapped = "\u0120" + tail if pre[0] == " " else pre
            else:
                mapped = pre.encode("utf-8").decode("latin-1").translate(self.chars)
            got = self._bytes([t.id for t in self.tok.model.tokenize(mapped)])
            if len(self.words) >= WORD_ENTRIES:
                self.words.clear()
            self.words[pre] = got
        return got

    def _words(self, names: pa.Array) -> list[bytes]:
        """As ``_word`` for many different pre-tokens: their bytes are mapped at once, ids become bytes by the thousand."""
        texts = _strings(names)
        got = list(map(self.words.get, texts))
        fresh = [k for k, ids in enumerate(got) if ids is None]
        new = names.take(pa.array(fresh, pa.int64()))
        ends = np.cumsum(np.asarray(pc.binary_length(new))).tolist()
        mapped = self.codes[np.frombuffer("".join([texts[k] for k in fresh]).encode("utf-8"), np.uint8)].tobytes().decode("utf-32-le")
        tokenize, size = self.tok.model.tokenize, self.dtype.itemsize
        for lo in range(0, len(fresh), 4096):
            own = ends[lo : lo + 4096]
            tokens = [tokenize(mapped[a:z]) for a, z in zip([ends[lo - 1] if lo else 0, *own], own, strict=False)]
            raw, at = self._bytes([t.id for ts in tokens for t in ts]), 0
            for k, ts in zip(fresh[lo : lo + 4096], tokens, strict=True):
                got[k] = raw[at : at + size * len(ts)]
                at += size * len(ts)
        if len(self.words) + len(fresh) > WORD_ENTRIES:
            self.words.clear()
        self.words.update((texts[k], got[k]) for k in fresh[:WORD_ENTRIES])
        return got

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece. Beyond Latin letters, and for special strings, the library does all of it."""
        ascii_only = piece.isascii()
        if not ascii_only and max(piece) > "\u024f" or "<|" in piece and any(s in piece for s in self.specials):
            return self._bytes(self.tok.encode(piece, add_special_tokens=False).ids)
        if self.kind == "word":
            piece = piece.lower() if ascii_only else unicodedata.normalize("NFC", piece).lower()
        return b"".join(map(self._word, self.find(piece)))

    def _flat(self, got: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, got), np.int64, len(got)) // self.dtype.itemsize
        return np.frombuffer(b"".join(got), self.dtype), n

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number for each piece."""
        return self._flat([self._piece(p) for p in pieces])

    def _joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encoded`` for pieces that a space precedes: those of letters alone are pre-tokens, those of the others are
        found in one pass over them, with a mark between every two, and each distinct pre-token is encoded once. Odd pieces
        go one by one."""
        lead = " " if self.kind == "byte" else ""
        letters = np.asarray(pc.match_substring_regex(pieces, _LETTERS[self.kind]))
        if letters.any():
            words = pieces.filter(pa.array(letters))
            words = pc.binary_join_element_wise(pa.scalar(lead, pa.large_string()), words, pa.scalar("", pa.large_string())) if self.kind == "byte" else pc.utf8_lower(words)
            one, n = self._flat(self._words(words))
            ids, counts = one, np.zeros(len(pieces), np.int64)
            counts[letters] = n
            if not letters.all():
                rest, counts[~letters] = self._mixed(pieces.filter(pa.array(~letters)))
                ids, own = np.empty(len(one) + len(rest), self.dtype), np.repeat(letters, counts)
                ids[own], ids[~own] = one, rest
            return ids, counts
        return self._mixed(pieces)

    def _mixed(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_joined`` of pieces that have other characters than letters."""
        lead = " " if self.kind == "byte" else ""
        odd = np.asarray(pc.match_substring_regex(pieces, _ODD))
        plain = pieces.filter(pa.array(~odd))
        text = f" {_MARK} ".join(["", *_strings(plain)])
        if self.kind == "word":
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        coded = pa.array(self.find(text), pa.large_string()).dictionary_encode()
        which = np.asarray(coded.indices)
        mark = pc.index(coded.dictionary, lead + _MARK).as_py()
        names = self._words(coded.dictionary)
        if mark >= 0:
            names[mark] = b""
        flat, n = self._flat(names)
        ids, counts = flat[_gather((np.cumsum(n) - n)[which], n[which])], np.zeros(len(pieces), np.int64)
        if len(plain):
            counts[~odd] = np.add.reduceat(n[which], np.flatnonzero(which == mark))
        if odd.any():
            alone, m = self._encoded([lead + w for w in _strings(pieces.filter(pa.array(odd)))])
            counts[odd] = m
            out = np.empty(len(ids) + len(alone), self.dtype)
            own = np.repeat(odd, counts)
            out[own], out[~own] = alone, ids
            ids = out
        return ids, counts

    def _batch(self, parts: list[str], heads: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For parts of texts (heads: whether a part begins its text, and so has no space before it): pieces' index
        into the distinct ones, pieces per part, the distinct ones' ids and their number."""
        lead = " " if self.kind == "byte" else ""
        texts = pa.array(parts, pa.large_string())
        if pc.any(pc.match_substring_regex(texts, _UNSAFE_ARROW)).as_py():
            rows = [_SAFE_CUT.split(x) if _UNSAFE(x) else x.split(" ") for x in parts]
            counts = np.array([len(r) for r in rows])
            flat = pa.array([p for r in rows for p in r], pa.large_string())
        else:
            lists = pc.split_pattern(texts, " ")
            counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            flat = lists.flatten()
        coded = flat.dictionary_encode()
        words = coded.dictionary
        index = np.asarray(coded.indices).astype(np.int64)
        place = np.full(len(words), -1, np.int64)  # the batch's few words are hashed, not the memo's many
        known = np.asarray(pc.fill_null(pc.index_in(self.memo, value_set=words), -1))
        met = np.flatnonzero(known >= 0)
        place[known[met]] = met
        fresh = np.flatnonzero(place < 0)
        new = words.take(pa.array(fresh))
        ids, n = self._joined(new)
        place[fresh] = len(self.memo) + np.arange(len(fresh))
        all_ids, all_n = np.concatenate([self.memo_ids, ids]), np.concatenate([self.memo_n, n])
        index = place[index]
        begin = np.cumsum(all_n) - all_n
        if len(all_n) <= MEMO_ENTRIES:
            self.memo, self.memo_ids, self.memo_n = pa.concat_arrays([self.memo, new]), all_ids, all_n
        elif len(words) <= MEMO_ENTRIES // 2:  # what this batch used stays, the frequent pieces among it
            take = all_n[place]
            self.memo, self.memo_ids, self.memo_n = words, all_ids[_gather(begin[place], take)], take
        if lead:  # a text's first piece has no space before it
            first = (np.cumsum(counts) - counts)[np.array(heads, bool)]
            alone, n = self._encoded(_strings(flat.take(pa.array(first))))
            index[first] = len(all_n) + np.arange(len(first))
            all_ids, all_n = np.concatenate([all_ids, alone]), np.concatenate([all_n, n])
        return index, counts, all_ids, all_n

    def parts(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str], list[bool]]]:
        """Batches of about BATCH_BYTES: the number of each part's text, the part, whether it begins the text."""
        which, parts, heads, size = [], [], [], 0
        for k, text in enumerate(texts):
            text, at = text or "", 0
            while True:
                cut = len(text)
                if cut - at > BATCH_BYTES - size and cut - at > 1:
                    cut = self.boundary(text, at + max(BATCH_BYTES - size, 1))
                which.append(k), parts.append(text[at:cut]), heads.append(at == 0)
                size += cut - at
                at = cut + 1  # the space at the cut stands before every part but the first
                if size >= BATCH_BYTES:
                    yield which, parts, heads
                    which, parts, heads, size = [], [], [], 0
                if cut >= len(text):
                    break
        if which:
            yield which, parts, heads

    @staticmethod
    def boundary(text: str, near: int) -> int:
        """The first safe boundary at or after ``near``; the text's end if there is none."""
        found = _SAFE_CUT.search(text, near)
        return found.start() if found else len(text)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        if self.kind in ("other", "sentencepiece"):
            for k, ids in self._whole(texts):
                out[k] = len(ids)
            return out
        for which, parts, heads in self.parts(texts):
            index, counts, _, n = self._batch(parts, heads)
            sums = np.concatenate([[0], np.cumsum(n[index])])
            ends = np.cumsum(counts)
            np.add.at(out, which, sums[ends] - sums[ends - counts])
        return out

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, one after another, and the number of ids of each text."""
        out, flat = np.zeros(len(texts), np.int64), []
        if self.kind in ("other", "sentencepiece"):
            for k, ids in self._whole(texts):
                out[k] = len(ids)
                flat.append(np.array(ids, self.dtype))
            return (np.concatenate(flat) if flat else np.zeros(0, self.dtype)), out
        for which, parts, heads in self.parts(texts):
            index, counts, ids, n = self._batch(parts, heads)
            take = n[index]
            flat.append(ids[_gather((np.cumsum(n) - n)[index], take)])
            sums, last = np.concatenate([[0], np.cumsum(take)]), np.cumsum(counts)
            np.add.at(out, which, sums[last] - sums[last - counts])
        return (np.concatenate(flat) if flat else np.zeros(0, self.dtype)), out

    def _whole(self, texts: list[str | None]) -> Iterator[tuple[int, list[int]]]:
        batch, size = [], 0

        def run() -> Iterator[tuple[int, list[int]]]:
            if self.kind == "sentencepiece":
                yield from zip([k for k, _ in batch], self.sp.encode([t for _, t in batch], num_threads=1), strict=True)
            else:
                coded = self.tok.encode_batch([t for _, t in batch], add_special_tokens=False)
                yield from ((k, x.ids) for (k, _), x in zip(batch, coded, strict=True))

        for k, text in enumerate(texts):
            batch.append((k, text or ""))
            size += len(text or "")
            if size >= BATCH_BYTES:
                yield from run()
                batch, size = [], 0
        if batch:
            yield from run()


def _strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, without a scalar for each row."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _gather(begin: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + take[i] - 1 for each i, one after another."""
    ends = np.cumsum(take)
    return np.repeat(begin - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker and vocabulary; its memo lives until the worker forgets it for another operator."""
    if path not in KEPT:
        KEPT[path] = PieceEncoder(path)
    return KEPT[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
