"""Exact token ids by pre-token: a word that was encoded before is looked up.

BPE never merges across a pre-token, so a text's ids are its pre-tokens' ids in
order.  The pre-tokens are found here only in texts whose characters all lie in
a small range (ASCII and the Latin letters up to U+017F), where the splitting
rule of the vocabulary file can be stated without doubt; every other text, and
every text that holds a special token's string, goes to the library whole.  The
library's BPE model merges each new pre-token.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array

from tessera.llm.common import tokenizer_file

LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
SPACES = "\t-\r "

#: The splitting rules that the two vocabulary files name, over
#: the plain range.  Letters come first, as most pre-tokens start with one.
RULES = {
    "bytes": f" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^{SPACES}{LETTERS}0-9]+"
             f"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+",
    "words": f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^{SPACES}{LETTERS}0-9]+",
}


#: White space that the rule "words" drops.
SPACES_DROPPED = frozenset("\t\n\v\f\r ")



def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: visible
    Latin-1 characters stand for themselves, the others for those from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def binary_slices(data: bytes, ends):
    """Arrow binary column of consecutive slices of ``data``, which end at
    ``ends[1:]``."""
    import numpy as np
    import pyarrow as pa
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.asarray(ends, dtype=np.int32)), pa.py_buffer(data)])


def plain_rule_holds(file: dict, rule: str) -> bool:
    """Whether a vocabulary file splits and normalises as ``RULES`` says."""
    before, splits = file.get("normalizer"), file.get("pre_tokenizer") or {}
    if rule == "bytes":
        return before is None and splits.get("type") == "ByteLevel" and splits["use_regex"] and not splits["add_prefix_space"]
    steps, parts = (before or {}).get("normalizers", []), splits.get("pretokenizers", [])
    words = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    return ([s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and len(parts) == 2 and parts[0] == words
            and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"])


LETTER, DIGIT, OTHER, SPACE, OUTSIDE = range(5)


def _byte_kinds() -> bytes:
    """Kind of each byte of a text's UTF-8; letters beyond ASCII are two bytes,
    the first 0xC3 to 0xC5 in the plain range."""
    kinds = bytearray([OTHER] * 256)
    for kind, members in ((LETTER, [*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]),
                          (DIGIT, range(48, 58)), (SPACE, [*range(9, 14), 32]), (OUTSIDE, [0xC2, *range(0xC6, 256)])):
        for k in members:
            kinds[k] = kind
    return bytes(kinds)


KINDS = _byte_kinds()
#: Marks the first bytes of the signs among the plain range's letters that are none, or whose small form is not one letter.
MIXED = bytes(k in (0xC3, 0xC4) for k in range(256))
NO_LETTERS = [int.from_bytes(x.encode()) for x in "×÷İ"]


def content(texts):
    """(bytes, ends) of all texts of an Arrow column without nulls, one after
    the other as UTF-8, and where each text ends there, from 0."""
    import numpy as np
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    ends = np.frombuffer(offsets, dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def _in_texts(at, ends):
    """How many of the places ``at``, in ascending order, lie in each text."""
    import numpy as np
    return np.diff(np.searchsorted(at, ends))


def plain_texts(texts, specials: list[str]):
    """Which texts of an Arrow column hold no character beyond the plain range
    and none of the strings ``specials``."""
    import numpy as np
    import pyarrow.compute as pc
    raw, ends = content(texts)
    outside = np.frombuffer(raw.tobytes().translate(KINDS), dtype=np.uint8) == OUTSIDE
    first = np.flatnonzero(np.frombuffer(raw.tobytes().translate(MIXED), dtype=bool))
    outside[first] |= np.isin(raw[first].astype(np.int64) << 8 | raw[first + 1], NO_LETTERS)
    plain = _in_texts(np.flatnonzero(outside), ends) == 0
    for special in specials:
        plain &= ~pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
    return plain


class Pieces:
    """The pre-tokens and runs of white space of plain texts by a rule of
    ``RULES``, as its pattern finds them, but for all texts at once.

    ``distinct`` holds the different ones, ``of`` the place there of each one in
    order, ``ends`` where each text's ones end, from 0.  ``cut`` tells which
    texts hold a contraction."""

    def __init__(self, texts, rule: str):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        raw, ends = content(pc.utf8_lower(texts) if rule == "words" else texts)
        kind = np.frombuffer(raw.tobytes().translate(KINDS), dtype=np.uint8)
        cuts = np.ones(len(raw) + 1, dtype=bool)
        cuts[1:-1] = kind[1:] != kind[:-1]
        if rule == "words":
            cuts[:-1] |= kind == DIGIT
        begins = np.zeros(len(raw) + 1, dtype=bool)
        begins[ends] = True
        cuts |= begins
        if rule == "bytes":         # the last sign of white space before a pre-token is one by itself, a space is part of what follows
            after = 1 + np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE))
            after = after[~begins[after]]
            cuts[after - 1] = True
            cuts[after[raw[after - 1] == 32]] = False
        signs = np.append(raw, [0, 0, 0])
        at = np.flatnonzero((raw == 39) & cuts[:-1])
        at = at[~begins[at + 1]]
        one, two = signs[at + 1], signs[at + 2]
        long = np.zeros(len(at), dtype=bool)
        for a, b in (b"re", b"ve", b"ll"):
            long |= (one == a) & (two == b) & ~begins[np.minimum(at + 2, len(raw))]
        short = np.isin(one, list(b"stmd"))
        at, long = at[short | long], long[short | long]
        cuts[at + 1] = False
        cuts[at + 2 + long] = True
        self.cut = _in_texts(at, ends) > 0
        bounds = np.flatnonzero(cuts)
        whole = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw))
        found = whole.dictionary_encode()
        self.of = found.indices.to_numpy()
        self.distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.ends = np.searchsorted(bounds, ends)


def text_slices(texts, most: int = 1 << 22):
    """(begin, length) of slices of an Arrow column of texts, of about ``most``
    bytes: one text or more."""
    import numpy as np
    ends = content(texts)[1]
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, upto - at
        at = upto


class Merged(dict):
    """Ids of pre-tokens, or their number, found when first asked for.  The generation before
    is asked first; what it still knows moves on to this one."""

    def __init__(self, merge, before: dict):
        super().__init__()
        self.merge, self.before = merge, before

    def __missing__(self, word: str):
        found = self.before.get(word)
        if found is None:
            found = self.merge(word)
        self[word] = found
        return found


class IdEncoder:
    """``encode(texts)``: little-endian unsigned 32-bit ids of each text, as
    the ``tokenizers`` library gives them without added special tokens."""

    def __init__(self, file: str, rule: str, kept: int = 150_000):
        """``kept``: pre-tokens in each of the two generations remembered."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer
        path = tokenizer_file(file)
        self.library = Tokenizer.from_file(path)
        self.merge, self.letters = self.library.model.tokenize, byte_letters()
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        added = content.get("added_tokens", [])
        self.lower = rule == "words"
        self.dropped = SPACES_DROPPED if self.lower else frozenset()
        self.find = re.compile(RULES[rule]).findall
        self.find_ascii = re.compile(RULES[rule].replace(LETTERS, "A-Za-z")).findall
        self.rule, self.specials = rule, [t["content"] for t in added]
        if not plain_rule_holds(content, rule):
            self.specials = [""]            # found in every text: all go to the library
        special = "|".join(map(re.escape, self.specials)) if self.specials else r"(?!)"
        self.special = re.compile(special).search
        self.beyond = re.compile(f"[^\x00-\x7f{LETTERS}]|{special}").search
        self.known, self.kept = Merged(self._merge, {}), kept
        self.sizes = Merged(self._size, {})
        self.space = self.letters[ord(" ")]
        self.sought, self.look, self.watched = None, None, {}

    def _merge(self, word: str) -> bytes:
        # Visible ASCII stands for itself.
        letters = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _ask(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        whole = []
        known = self.known.__getitem__
        for i, t in enumerate(texts):
            ascii = t.isascii()
            if self.special(t) if ascii else self.beyond(t):
                whole.append(i)
            else:
                out[i] = b"".join(map(known, (self.find_ascii if ascii else self.find)(t.lower() if self.lower else t)))
        if len(self.known) > self.kept:
            self.known.before = {}
            self.known = Merged(self._merge, self.known)
        for i, ids in zip(whole, self._ask([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def _split(self, texts):
        """(pieces, their number in each text, whole): texts are split here, but
        those numbered in ``whole`` go to the library."""
        import numpy as np
        import pyarrow as pa
        plain = plain_texts(texts, self.specials)
        pieces = Pieces(texts if plain.all() else texts.filter(pa.array(plain)), self.rule)
        n = np.zeros(len(texts), dtype=np.int64)
        n[plain] = np.diff(pieces.ends)
        return pieces, n, np.flatnonzero(~plain)

    def encode_column(self, texts, end: int):
        """(values, lengths) of an Arrow column of texts without nulls: the ids
        of all texts one after the other, each text's followed by ``end``, and
        how many each text has.  A pre-token is looked up once for all texts."""
        import numpy as np
        import pyarrow as pa
        pieces, n, whole = self._split(texts)
        known, dropped = self.known, self.dropped
        ids = [b"" if x[0] in dropped else known[x] for x in pieces.distinct]
        # What closes a text: the end id, after all ids of one that the library encoded.
        close, closing = end.to_bytes(4, "little"), np.full(len(texts), len(ids))
        closing[whole] += 1 + np.arange(len(whole))
        ids += [close] + [x + close for x in self._ask(texts.take(pa.array(whole)).to_pylist())]
        order = np.insert(pieces.of, np.cumsum(n), closing)
        data, upto = content(pa.array(ids, pa.binary()).take(pa.array(order)))
        if len(known) > self.kept:
            known.before = {}
            self.known = Merged(self._merge, known)
        return data.view("<u4"), np.diff(upto[np.append(0, np.cumsum(n + 1))]) // 4

    def _size(self, word: str) -> int:
        if self.look and (seen := self.look(word)):
            self.watched[word] = seen
        # Visible ASCII stands for itself; the only other sign there is mostly one space.
        bare = word[1:] if word[0] == " " else word
        if bare.isascii() and bare.isalnum():
            return len(self.merge(word if bare is word else self.space + bare))
        return len(self.merge(word.encode().decode("latin-1").translate(self.letters)))

    def watch(self, sought, look) -> None:
        """Let ``measure_column`` tell what ``look`` sees in a text's pre-tokens; it is
        asked once for each that is remembered.  ``sought`` names the look: a
        worker keeps what it knows while that stays the same."""
        if sought != self.sought:
            self.sought, self.look, self.watched = sought, look, {}
            self.sizes = Merged(self._size, {})

    def measure_column(self, texts) -> tuple[list[int], list[list | None]]:
        """For each text of an Arrow column without nulls the number of its ids,
        and what the look saw in each pre-token where it saw something.  Sizes
        of pre-tokens are remembered apart from their ids: they take less
        memory, and less to add up.  Nothing is told (None) of a text whose runs
        of letters are not its pre-tokens: one that goes to the library whole,
        or that has a contraction, which may cut a run."""
        import numpy as np
        import pyarrow as pa
        pieces, n, whole = self._split(texts)
        known, dropped = self.sizes, self.dropped
        sizes = np.array([0 if x[0] in dropped else known[x] for x in pieces.distinct], dtype=np.int64)
        ends = np.append(0, np.cumsum(n))
        total = np.diff(np.append(0, np.cumsum(sizes[pieces.of]))[ends])
        total[whole] = [len(x) // 4 for x in self._ask(texts.take(pa.array(whole)).to_pylist())]
        seen = list(map(self.watched.get, pieces.distinct))
        at = np.flatnonzero(np.fromiter(map(bool, seen), dtype=bool, count=len(seen))[pieces.of])
        told, upto = [seen[k] for k in pieces.of[at].tolist()], np.searchsorted(at, ends).tolist()
        own = [told[a:b] for a, b in zip(upto[:-1], upto[1:], strict=True)]
        untold = np.zeros(len(texts), dtype=bool)
        untold[whole] = True
        untold[~untold] = pieces.cut
        for i in np.flatnonzero(untold).tolist():
            own[i] = None
        if len(known) > self.kept:
            known.before = {}
            self.watched = {w: seen for w, seen in self.watched.items() if w in known}
            self.sizes = Merged(self._size, known)
        return total.tolist(), own

    def measure(self, text: str) -> tuple[int, list | None]:
        """``measure_column`` of one text."""
        import pyarrow as pa
        n, told = self.measure_column(pa.array([text], pa.string()))
        return n[0], told[0]

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        import pyarrow as pa
        return self.measure_column(pa.array(texts, pa.string()))[0]


@functools.cache
def worker_encoder(file: str, rule: str, kept: int) -> IdEncoder:
    """The encoder of this Python worker, which serves many tasks."""
    return IdEncoder(file, rule, kept)
