"""Bulk encoding with a public tokenizer file of the tokenizers library.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` on the whole text.
Most of a text's words recur, so texts are cut into pieces first, the pieces of a slice are made
distinct by Arrow, and only pieces that the worker has not seen lately go to the tokenizer. Cuts
stand only where the library's own pre-tokenizers always end a piece, whatever is around:

* before white space that follows something else (or begins the text): no piece of either family holds white space
  after another character, and a run of white space stays whole, so its lookahead sees the same;
* between a letter and a punctuation mark: a run of letters ends there;
* between a punctuation mark other than the apostrophe and a letter (an apostrophe may begin a
  contraction).

Letters count here only up to U+024F (without U+0130, whose lower case ends in a mark) and marks of punctuation only in ASCII, where Unicode
versions agree and nothing combines with what stands before it. Texts that hold the string of a
special token, which the library finds before any cutting, are encoded whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import by_value, worker_cache

by_value(__name__)

CACHE, LONGEST = 200_000, 64
#: Stands between pieces of a text; texts that hold one are encoded whole.
CUT = "\x01"
_LETTER = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
_MARK = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation without the apostrophe
_SPACES = r"\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"


def byte_characters() -> list[str]:
    """The visible character of each byte in byte-level vocabularies: its own where it is
    printable, else one from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Encoder:
    def __init__(self, definition: str, blank_leads: bool):
        """definition: the tokenizer file's text. blank_leads: a word's token holds the blank before it."""
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.blank_leads, self.known, self.older = blank_leads, {}, {}
        self.table = byte_characters()
        self.odd = "|".join(re.escape(x) for x in [CUT, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())])
        self.word = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch

    def _raw(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=np.uint32).tobytes() for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters straight from the model: such a word is one piece to both
        families' rules and its own normal form, so only case and its bytes' characters are left."""
        model, table, lower = self.tokenizer.model.tokenize, self.table, not self.blank_leads
        return [array("I", [t.id for t in model("".join([table[b] for b in (w.lower() if lower else w).encode()]))]).tobytes() for w in words]

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, by two generations of remembered ones: what is used again stays."""
        known, older = self.known, self.older
        out = [known.get(p) for p in pieces]
        missing = []
        for i, x in enumerate(out):
            if x is None:
                x = older.get(pieces[i])
                if x is None:
                    missing.append(i)
                else:
                    out[i] = known[pieces[i]] = x
        plain, other = [], []
        for i in missing:
            w = pieces[i][1:] if pieces[i][:1] == " " else pieces[i]
            (plain if self.word(w) else other).append(i)
        for which, made in ((plain, self._words([pieces[i] if self.blank_leads else pieces[i].lstrip(" ") for i in plain])), (other, self._raw([pieces[i] for i in other]))):
            for i, raw in zip(which, made):
                out[i] = raw
                if len(pieces[i]) <= LONGEST:
                    known[pieces[i]] = raw
        if len(known) > CACHE:
            self.known, self.older = {}, known
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, flat, and the number of ids of each text (null: none)."""
        texts = pc.fill_null(texts, "")
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        apart = texts if not whole.any() else pc.if_else(pa.array(whole), "", texts)
        # white space that stands alone is cut off by plain replacements, runs of it by an expression
        runs = pc.match_substring_regex(apart, rf"[{_SPACES}][{_SPACES}]").to_numpy(zero_copy_only=False)
        plain = apart
        for c in (" ", "\n"):
            plain = pc.replace_substring(plain, c, CUT + c)
        if runs.any():
            held = pc.replace_substring_regex(apart.filter(pa.array(runs)), rf"([^{_SPACES}])([ \n\r\t])", r"\1" + CUT + r"\2")
            plain = pc.replace_with_mask(plain, pa.array(runs), held)
        apart = plain
        apart = pc.replace_substring_regex(apart, rf"([{_LETTER}])([{_MARK}'])", r"\1" + CUT + r"\2")
        apart = pc.replace_substring_regex(apart, rf"([{_MARK}])([{_LETTER}])", r"\1" + CUT + r"\2")
        cut = pc.split_pattern(apart, CUT)
        flat = cut.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        values = self._ids(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        if whole.any():  # such a text is one piece
            code[starts[whole]] = len(values) + np.arange(int(whole.sum()))
            values += self._raw([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
        table = np.frombuffer(b"".join(values), dtype=np.uint32)
        width = np.array([len(v) for v in values], dtype=np.int64) // 4
        offset = np.cumsum(width) - width
        each = width[code]
        ahead = np.cumsum(each) - each
        ids = table[np.repeat(offset[code] - ahead, each) + np.arange(int(each.sum()))]
        return ids, np.add.reduceat(each, starts)


def worker_encoder(key: str, definition: str, blank_leads: bool) -> Encoder:
    """The process's encoder for a tokenizer; made once."""
    cache = worker_cache()
    if ("encoder", key) not in cache:
        cache["encoder", key] = Encoder(definition, blank_leads)
    return cache["encoder", key]


def text_slices(batch: pa.RecordBatch, at: int, limit: int = 1_500_000):
    """Slices of a batch with about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    i, size = 0, 0
    for j, s in enumerate(sizes.tolist()):
        if j > i and size + s > limit:
            yield batch.slice(i, j - i)
            i, size = j, 0
        size += s
    if i < batch.num_rows:
        yield batch.slice(i)
