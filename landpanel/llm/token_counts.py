"""Operator 7: token counts of whole documents, huge ones by overlap resynchronisation.

A huge document is encoded in chunks that overlap, with offsets. Two neighbouring chunks are spliced at a place inside
their overlap where both have a token that begins right after an ASCII white-space character, and from which both give
the same tokens up to the last such place that the first chunk is sure of. Such a place is stable by the make-up of the
encoder: its pre-tokenizer matches no white space, its normalizers neither compose across white space nor look past it,
and no special string holds any. This is read from the encoder when it is loaded; texts of an encoder of another make-up
are encoded whole. If the overlap holds no such place it is doubled, and where the whole chunk holds none the chunk is,
so that a text without white space costs a small multiple of encoding it once.

By the same fact a count is the sum over the parts between white space, so documents below the size of a chunk are
counted part by part through a bounded memo; only parts not met before reach the encoder. (The plain encoder's 1.3 MB a
second and core would take 770 CPU seconds a GB of text.)

Defined results: null text is the empty text, with 0 bytes and 0 tokens; a text without white space is encoded whole;
repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import ChainMap
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import by_blocks, only, text_or_empty

MEMO = 300_000
HUGE = 16_384
OVERLAP = 256
#: A place after ASCII white space at which something other than white space begins.
STABLE = re.compile(r"(?<=[\x20\x09-\x0D])[^\s]")


def splits_at_white_space(made: dict) -> bool:
    """Whether an encoder, as declared, gives a text the tokens of its parts between white space."""
    flat = lambda x, many: [] if x is None else [z for y in x[many] for z in flat(y, many)] if x["type"] == "Sequence" else [x]
    white = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    pre = flat(made.get("pre_tokenizer"), "pretokenizers")
    kept = pre and pre[0]["type"] == "Split" and pre[0].get("invert") and pre[0].get("behavior") == "Removed"
    pattern = pre[0]["pattern"].get("Regex", " ") if kept else " "
    # what the pattern matches is kept: letters, digits and what is none of these nor white space
    kept = kept and not re.search(r"\\s", pattern.replace(r"[^\s", "")) and " " not in pattern and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in pre[1:])
    plain = all(x["type"] in ("NFC", "Lowercase") or x == white for x in flat(made.get("normalizer"), "normalizers"))
    return bool(kept and plain and made["model"]["type"] == "BPE" and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in made["added_tokens"]))


class Counter:
    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.encoder, self.memo, self.older, self.limit, self.chunks = Tokenizer.from_file(path), {}, {}, memo, 1
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.splits = splits_at_white_space(json.loads(self.encoder.to_str()))

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Counter:
        return cls(path)

    def forget(self) -> None:
        self.memo, self.older = {}, {}

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """(start in the text, id) of every token."""
        e = self.encoder.encode(text, add_special_tokens=False)
        return list(zip((s for s, _ in e.offsets), e.ids, strict=True))

    def huge(self, text: str, chunk: int = HUGE, overlap: int = OVERLAP) -> int:
        """Tokens of a text, from chunks spliced at stable places; `chunks` then says how many there were."""
        self.chunks = 1
        total, start, n = 0, 0, len(text)  # everything before `start` is counted, and `start` is stable
        end = min(n, start + chunk)
        held = self.offsets(text[start:end])
        while end < n:
            wide = overlap
            while True:
                begin = max(start, end - wide)
                after_end = min(n, begin + chunk + wide)
                after = self.offsets(text[begin:after_end])
                splice = self.common(text, start, held, begin, after, end)
                if splice is not None:
                    self.chunks += 1
                    total += sum(s + start < splice for s, _ in held)
                    held, start, end = [(s + begin - splice, i) for s, i in after if s + begin >= splice], splice, after_end
                    break
                if begin == start:  # no stable place between them: grow the first chunk itself
                    end = min(n, start + 2 * (end - start))
                    held = self.offsets(text[start:end])
                    if end == n:
                        break
                else:
                    wide *= 2
        return total + len(held)

    @staticmethod
    def common(text: str, start: int, held: list, begin: int, after: list, end: int) -> int | None:
        """The last stable place in text[begin:end] from which no token of the first chunk can reach past its end.

        At least one whole part, up to a later stable place, must have come out alike in both.
        """
        places = [m.start() for m in STABLE.finditer(text, begin, end)]
        first = {s + start for s, _ in held}
        second = {s + begin for s, _ in after}
        places = [p for p in places if p in first and p in second]
        if len(places) < 2:
            return None
        a, b = places[-2:]
        same = [(s + start, i) for s, i in held if a <= s + start < b] == [(s + begin, i) for s, i in after if a <= s + begin < b]
        return b if same else None

    def parts(self, words: list[bytes]) -> dict[bytes, int]:
        """Tokens of parts without white space, encoded together with spaces between them."""
        out: dict[bytes, int] = {}
        for at in range(0, len(words), 4096):
            texts = [w.decode("utf-8", "surrogatepass") for w in words[at : at + 4096]]
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            e = self.encoder.encode(" ".join(texts), add_special_tokens=False)
            own = np.searchsorted(starts, np.fromiter((s for s, _ in e.offsets), np.int64, len(e)), "right") - 1
            out.update(zip(words[at : at + 4096], np.bincount(own, minlength=len(texts)).tolist(), strict=True))
        return out

    def whole(self, texts: list[str]) -> list[int]:
        return [len(self.encoder.encode(t, add_special_tokens=False)) for t in texts]

    def small(self, texts: list[str]) -> list[int]:
        memo, older = self.memo, self.older
        parts = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        new = {w for p in parts for w in p if w not in memo}
        again = {w: older[w] for w in new if w in older}
        found = again | self.parts([w for w in new if w not in again])
        get = ChainMap(found, memo).__getitem__ if len(memo) + len(found) > self.limit else (memo.update(found) or memo.__getitem__)
        out = [sum(map(get, p)) for p in parts]
        if len(memo) + len(found) > self.limit or any(len(w) > 64 for w in found):  # what was used lately stays for another round
            kept = {w: n for w, n in found.items() if len(w) <= 64}
            if len(memo) + len(kept) > self.limit:
                self.older, self.memo = memo, kept
            else:
                for w in found.keys() - kept.keys():
                    memo.pop(w, None)
        return out


def count_tokens(docs: DataFrame, model: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_chunks) for every row; n_chunks is 1 for a text that is not huge."""
    kind = docs.schema[id_col].dataType.simpleString()

    def block(rows):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        c = Counter.load(model)
        only("token_counts", c.forget)
        few = c.small([t if len(t) < huge else "" for _, t in rows]) if c.splits else c.whole([t for _, t in rows])
        out = []
        for (key, text), n in zip(rows, few, strict=True):
            c.chunks = 1
            n = c.huge(text, huge) if len(text) >= huge and c.splits else n
            out.append((key, len(text.encode("utf-8", "surrogatepass")), n, n > limit, c.chunks))
        return out

    return by_blocks(docs.select(id_col, text_or_empty(text_col).alias(text_col)), [id_col, text_col], f"{id_col} {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks int", block)
