"""Operator 6: exact encoding and decoding with a merge-type piece vocabulary, by backtracking.

`encode(docs, model)` gives the ids that the published encoder gives: white space becomes U+2581, one such mark is put
in front, and pieces are merged best score first, leftmost among equals. Instead of a merge queue, the encoder looks
for the one sequence of pieces in which every two neighbours, put together and merged again, come back as the same two
pieces. It takes the longest piece that an Aho-Corasick automaton finds at a position, checks it against the piece
before, tries shorter ones if they are not compatible, and steps back when none is left; a bit field remembers
positions from which the text cannot be finished, so each is tried once.

Two facts about the vocabulary, read from it and not assumed, keep this fast: between two characters that stand
side by side in no piece no merge ever happens, so a text falls apart there; and the parts repeat, so a bounded memo
holds them. Runs of two or more marks are merged directly, since their pieces share one score and the order among
equals matters.

Defined results: null text is the empty text; the empty text has no ids and decodes to itself; characters outside the
vocabulary become their UTF-8 bytes; repeated rows and equal ids give repeated, equal results; an empty table gives an
empty result; other columns of the input are not read. Texts of any length are encoded whole, part by part.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import by_blocks, only, text_or_empty

MARK = "▁"
MEMO = 150_000
WINDOW = 4096
#: Texts that normalisers, other marks for white space and other types of model would treat differently.
PROBES = ("", " ", "a", " a  b ", "word\tword\nword", "ﬁ Ａ１ é e\u0301 \u00a0 ½", "Internationalisation of 12,345 words", "▁a ▁▁b", "\U0001f600 日本語\x00")


def merge(text: str, score: dict[str, float]) -> list[str]:
    """Pieces of a short text by merging itself: best score first, leftmost among equals."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Pieces:
    """A vocabulary of pieces: {piece: (id, score)} for what merges, and the ids of the 256 bytes."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], memo: int = MEMO):
        import ahocorasick

        self.score = {p: s for p, (_, s) in pieces.items()}
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.byte_ids = byte_ids
        self.text = {i: p for p, (i, _) in pieces.items()}
        self.bytes = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.longest = max(map(len, pieces))
        self.auto = ahocorasick.Automaton()
        for p in pieces:
            self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.near = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # no piece has a mark after another character, so a text falls apart before each run of marks
        self.by_mark = not any(p[1] == MARK and p[0] != MARK for p in self.near)
        free = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in self.near)) if self.by_mark else ""
        self.cut = re.compile(rf"{MARK}*[^{MARK}{free}]+|{MARK}+" + (f"|[{free}]" if free else "")) if self.by_mark else re.compile(r"(?s).+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.limit = memo

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(m.get_piece_size())
        plain = {m.id_to_piece(i): (i, m.get_score(i)) for i in n if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        out = cls(plain, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        for text in PROBES:
            if out.encode(text) != m.encode(text) or out.decode(m.encode(text)) != m.decode(m.encode(text)):
                raise ValueError(f"{path}: not a merge-type model without a normaliser: {text!r} comes out differently")
        return out

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            known = self.pairs[key] = a[-1] + b[0] not in self.near or merge(a + b, self.score) == [a, b]
        return known

    def matches(self, text: str, start: int) -> list[list[int]]:
        """For each position of a window, the lengths of the pieces that begin there, shortest first."""
        part = text[start : start + WINDOW + self.longest]
        out: list[list[int]] = [[1] for _ in range(min(WINDOW, len(text) - start))]  # a lone character is always possible
        for end, n in self.auto.iter(part):
            if n > 1 and end - n + 1 < len(out):
                out[end - n + 1].append(n)
        return out

    def backtrack(self, text: str) -> list[str]:
        n, at = len(text), 0
        failed = bytearray(n // 8 + 1)
        windows: dict[int, list[list[int]]] = {}
        path: list[tuple[str, int]] = []  # a piece, and which of the lengths at its place it has

        def lengths(i: int) -> list[int]:
            w = i // WINDOW
            if w not in windows:
                while len(windows) > 2:
                    windows.pop(min(windows, key=lambda k: -abs(k - w)))
                windows[w] = self.matches(text, w * WINDOW)
            return windows[w][i % WINDOW]

        turn = -1  # -1: begin with the longest
        while at < n:
            found = lengths(at)
            k = len(found) - 1 if turn < 0 else turn - 1
            while k >= 0:
                end = at + found[k]
                if not failed[end >> 3] >> (end & 7) & 1:
                    piece = text[at:end]
                    if self.compatible(path[-1][0], piece) if path else True:
                        break
                k -= 1
            if k >= 0:
                path.append((piece, k))
                at, turn = end, -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not path:
                    raise ValueError("no sequence of pieces fits")
                piece, turn = path.pop()
                at -= len(piece)
        return [p for p, _ in path]

    def short(self, text: str) -> list[str]:
        """As backtrack(), for a text within one window."""
        n, at, failed, turn = len(text), 0, 0, -1
        lengths: list[list[int]] = [[1] for _ in range(n)]
        for end, size in self.auto.iter(text):
            if size > 1:
                lengths[end - size + 1].append(size)
        pieces, turns, known = [""], [], self.pairs
        while at < n:
            found, before = lengths[at], pieces[-1]
            k = len(found) - 1 if turn < 0 else turn - 1
            while k >= 0:
                end = at + found[k]
                if not failed >> end & 1:
                    piece = text[at:end]
                    ok = known.get((before, piece))
                    if ok or ok is None and (not before or self.compatible(before, piece)):
                        break
                k -= 1
            if k >= 0:
                pieces.append(piece)
                turns.append(k)
                at, turn = end, -1
            else:
                failed |= 1 << at
                if not turns:
                    raise ValueError("no sequence of pieces fits")
                turn = turns.pop()
                at -= len(pieces.pop())
        return pieces[1:]

    def split(self, part: str) -> list[str]:
        """The pieces of one part of a text."""
        if part.startswith(MARK + MARK):  # the marks before the last merge among themselves, or the last one joins the word
            return self.marked(part, len(part) - len(part.lstrip(MARK)))
        return self.short(part) if len(part) <= WINDOW else self.backtrack(part)

    def marked(self, part: str, run: int) -> list[str]:
        if run == len(part):
            return self.marks(run)
        rest = self.split(part[run - 1 :])
        if len(rest[0]) > 1:  # the last mark belongs to the word
            return self.marks(run - 1) + rest
        return self.marks(run) + rest[1:]

    @lru_cache(maxsize=4096)  # noqa: B019
    def marks(self, n: int) -> list[str]:
        """A run of marks: all its pieces share a score, so passes from the left merge it, a pass for each doubling."""
        parts = [MARK] * n
        equal = len({s for p, s in self.score.items() if len(p) > 1 and not p.strip(MARK)}) <= 1
        if n <= 64 or not equal:
            return merge(MARK * n, self.score)
        # leftmost first with equal scores: the first piece grows as far as the vocabulary allows, then the next
        return leftmost(parts, self.score)

    def one(self, part: str) -> str:
        """The ids of a part, joined by commas, and a `!` at the end if they do not decode to it.

        A part met for the first time falls apart where no merge can cross; those smaller parts are looked up too. Its
        ids are decoded when it is met and bytes are among them.
        """
        if (known := self.memo.get(part) or self.older.get(part)) is None:
            near = self.near
            cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in near]
            if cuts and not part.startswith(MARK + MARK):
                known = ",".join([self.one(part[i:j]) for i, j in zip([0, *cuts], [*cuts, len(part)], strict=True)])
            else:
                ids, raw = [], False
                for p in self.split(part):
                    i = self.ids.get(p)
                    raw |= i is None
                    ids += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
                known = ",".join(map(str, ids))
                if raw and self.decode_part(ids) != part.replace(MARK, " "):  # pieces alone are the part itself
                    known += "!"
        if len(part) <= 64:
            if len(self.memo) >= self.limit:  # what was used lately stays for another round
                self.older, self.memo = self.memo, {}
            self.memo[part] = known
        return known

    def decode_part(self, ids: list[int]) -> str:
        try:
            return "".join([self.text[i] for i in ids]).replace(MARK, " ")
        except KeyError:  # there are bytes
            out, raw = [], b""
        for i in ids:
            if i in self.bytes:
                raw += self.bytes[i]
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = b""
            out.append(self.text[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")

    def forget(self) -> None:
        self.memo, self.older, self.pairs = {}, {}, {}

    def both(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text)."""
        if not text:
            return "", ""
        marked, memo, one = MARK + text.replace(" ", MARK), self.memo, self.one
        ids = ",".join([memo.get(p) or one(p) for p in self.cut.findall(marked)])
        if "!" in ids:
            ids = ids.replace("!", "")
            return ids, self.decode(list(map(int, ids.split(","))))
        return ids, marked.replace(MARK, " ")[1:]  # every part was found to decode to itself

    def encode(self, text: str) -> list[int]:
        ids = self.both(text)[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_part(ids).removeprefix(" ")


def leftmost(parts: list[str], score: dict[str, float]) -> list[str]:
    """Merging among pieces of one score: always the leftmost pair that fits, found by stepping back after a merge."""
    out: list[str] = []
    for p in parts:
        out.append(p)
        while len(out) > 1 and out[-2] + out[-1] in score:
            out[-2:] = [out[-2] + out[-1]]
    return out


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), and the ids and the decoded text themselves if asked for, and columns carried along."""
    keys = [id_col, *(carry or [])]
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    schema = f"{kinds}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def block(rows):
        v, out = Pieces.load(model), []
        only("pieces", v.forget)
        for *key, text in rows:
            ids, decoded = v.both(text)
            row = (*key, ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            out.append(row + ((np.fromstring(ids, np.int32, sep=","), decoded) if with_ids else ()))
        return out

    return by_blocks(docs.select(*keys, text_or_empty(text_col).alias(text_col)), [*keys, text_col], schema, block, chars=1_000_000)
