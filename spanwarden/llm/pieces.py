"""Tokenizer access that encodes each distinct piece of text once.

A text is split at safe boundaries: places where the tokenizer's own rules end a
token whatever stands on either side. The pieces' ids then join to the ids of the
whole text, so a long text never has to be encoded in one call and a word that
occurs a thousand times is encoded once. Which boundaries are safe is decided for
each tokenizer (``PieceEncoder.mode``):

* ``drop``: white space never reaches a token (words with an end mark). Pieces are
  what stands between runs of space, tab and newline.
  A full stop or comma between an ASCII letter and white space is a piece of its own.
* ``lead``: a space belongs to the word after it. A piece starts at each single
  space that stands between two ASCII letters.
* ``mark``: sentencepiece puts a mark before each word; again single spaces between
  ASCII letters, and the space itself is not part of a piece.
* ``whole``: no boundary is known to be safe; texts are encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
from contextlib import contextmanager
from collections.abc import Callable, Iterator

import numpy as np

LEAD = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
MARK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
DROP = re.compile(r"[ \t\n]+")
#: Characters that one call to the library gets, and that one group of texts holds.
CALL_CHARS, GROUP_CHARS = 1 << 18, 1 << 22
#: Pieces kept by a worker, in two generations of half as many each (some 250 bytes for one).
KEPT = 1_000_000
#: A full stop or comma that ends a word of ASCII letters.
TAIL = re.compile(r"[.,](?=[ \n]|$)(?<=[A-Za-z][.,])")
#: Texts without these have the same lower case character by character, and no composition to undo.
UNEVEN = re.compile("[^\x00-\u012f\u0131-\u024f]|<\\|")


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: lists of words make none, and there are many."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def grouped(items: list[str], most: int) -> Iterator[list[str]]:
    """Runs of ``items`` of about ``most`` characters each; a longer item stands alone."""
    group, held = [], 0
    for x in items:
        if group and held + len(x) > most:
            yield group
            group, held = [], 0
        group.append(x)
        held += len(x)
    if group:
        yield group


class PieceEncoder:
    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        self.encode, self.vocab_size, self.mode, self.ends, self.lower = _load(path)
        self._young: dict[str, bytes | int] = {}
        self._old: dict[str, bytes | int] = {}
        self._of: Callable | None = None

    def split(self, text: str) -> list[str]:
        if self.mode == "drop":
            plain = text.isascii()
            if self.lower and not ("<|" in text if plain else UNEVEN.search(text)):
                text = text.lower()
            text = TAIL.sub(r" \g<0>", text)
            return text.split() if plain and not any(x in text for x in _ODD) else DROP.split(text)
        if self.mode == "lead":
            return LEAD.split(text)
        if self.mode == "mark":
            return MARK.split(text)
        return [text]

    def _known(self, split: list[list[str]], of: Callable) -> dict:
        """Values of all pieces of ``split``: the young generation, with what they need of the old one and of the tokenizer.

        A full young generation becomes the old one, so pieces in use are never forgotten.
        """
        if self._of is not of:
            self._young, self._old, self._of = {}, {}, of
        seen = set().union(*split)
        new = seen - self._young.keys()
        if self._young and len(self._young) + len(new) > self.kept // 2:
            self._young, self._old, new = {}, self._young, seen
        cache, old = self._young, self._old
        back = new & old.keys()
        cache.update((x, old[x]) for x in back)
        rest = sorted(new - back, key=len)
        if self.ends is not None:
            plain, other = [], []
            for x in rest:
                (plain if x.isalpha() and (x.isascii() or not UNEVEN.search(x)) else other).append(x)
            rest = other
            for group in grouped(plain, CALL_CHARS):
                self._together(group, cache, of)
        for group in grouped(rest, CALL_CHARS):
            cache.update(zip(group, [of(np.array(x, "<u4").tobytes()) for x in self.encode(group)]))
        return cache

    def _together(self, group: list[str], cache: dict, of: Callable) -> None:
        """Words of letters, encoded in one text: each is one run of tokens, closed by the only token with an end mark."""
        ids = np.array(self.encode([" ".join(group)])[0], "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(group):
            raise ValueError("tokens with an end mark don't match the words")
        raw, at = ids.tobytes(), (4 * at).tolist()
        cache.update(zip(group, [of(raw[a:z]) for a, z in zip([0, *at], at)]))

    def lengths(self, texts: list[str]) -> list[int]:
        """Numbers of ids of whole texts."""
        out: list[int] = []
        for group in grouped(texts, min(GROUP_CHARS, 4 * self.kept)):
            with uncollected():
                split = [self.split(t) for t in group]
                get = self._known(split, _length).__getitem__
                out += [sum(map(get, x)) for x in split]
        return out

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of whole texts, unsigned 32-bit."""
        for group in grouped(texts, min(GROUP_CHARS, 4 * self.kept)):
            with uncollected():
                split = [self.split(t) for t in group]
                get = self._known(split, bytes).__getitem__
                raw = [b"".join(map(get, x)) for x in split]
                del split
            for x in raw:
                yield np.frombuffer(x, "<u4")


#: ASCII white space that str.split takes and DROP does not.
_ODD = "\x0b\x0c\r\x1c\x1d\x1e\x1f"
_LOADED: dict[str, PieceEncoder] = {}


def _length(raw: bytes) -> int:
    return len(raw) >> 2


def encoder(path: str, kept: int = KEPT) -> PieceEncoder:
    """One encoder for each worker process and file; it keeps about ``kept`` pieces."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    _LOADED[path].kept = kept
    return _LOADED[path]


def release() -> None:
    """Lets go of vocabularies and pieces: a worker outlives its stage, and the next one may need the memory."""
    _LOADED.clear()


def _load(path: str) -> tuple[Callable[[list[str]], list], int, str, np.ndarray | None, bool]:
    """The encoding function, the vocabulary's size, the mode, which ids carry an end mark, and whether case is dropped."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        inner = any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(size))
        probe = "ab cd the of house Xy"
        same = model.encode(probe) == [i for w in probe.split(" ") for i in model.encode(w)]
        return (lambda x: model.encode(x, num_threads=1)), size, "mark" if same and not inner else "whole", None, False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def encode(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    mode, size = _mode(model, encode), model.get_vocab_size()
    suffix = getattr(model.model, "end_of_word_suffix", None) if mode == "drop" else None
    if not suffix:
        return encode, size, mode, None, False
    ends = np.array([(model.id_to_token(i) or "").endswith(suffix) for i in range(size)])
    return encode, size, mode, ends, all(encode([x])[0] == encode([x.lower()])[0] for x in ("ABC", "Éa", "xÀ"))


def _mode(model, encode: Callable) -> str:
    """Whether white space is dropped or leads the next word, told from the tokenizer's parts and a probe."""
    import json

    parts = json.loads(model.to_str())
    added = [x for x in parts.get("added_tokens") or [] if re.search(r"\s", x["content"]) or x.get("lstrip") or x.get("rstrip") or x.get("single_word")]
    pre = json.dumps(parts.get("pre_tokenizer") or {})
    if added or parts.get("post_processor") and "TemplateProcessing" in json.dumps(parts["post_processor"]) or (parts.get("model") or {}).get("type") != "BPE":
        return "whole"
    cat = lambda *x: [i for y in encode(list(x)) for i in y]
    if '"Removed"' in pre and all(cat(f"{a}{s}{b}") == cat(a, b) for s in (" ", "\n", "\t ", "   ") for a, b in (("ab", "cd"), ("x,", "'s"), ("é", "7"))):
        return "drop"
    if '"ByteLevel"' in pre and '"add_prefix_space": true' not in pre and all(cat(f"{a} {b}") == cat(a, f" {b}") for a, b in (("ab", "cd"), ("the", "of"), ("I", "s"))):
        return "lead"
    return "whole"
