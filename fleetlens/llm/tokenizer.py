"""Tables of a public word BPE tokenizer file and its splitting of text into pre-tokens.

Everything here is a small per-task helper. The file (``tokenizers`` JSON, BPE
with an end-of-word suffix) is read once on the driver and broadcast: its size
is that of one vocabulary, whatever the data.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cached_property

import regex

MODEL_FILE = "word_bpe_49k.json"
# Pieces up to this many characters are kept in the cache of a worker.
CACHED_CHARS = 64
# Entries of the cache of a worker; when it is full it starts again.
CACHE_ENTRIES = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level files.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in own}
    for b in range(256):
        signs.setdefault(b, chr(0x100 + b - sum(1 for x in own if x < b)))
    return [signs[b] for b in range(256)]


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\U{points[i]:08x}-\\U{points[j]:08x}")
        i = j + 1
    return "".join(out)


class Tables:
    """The vocabulary, merges and character classes of one tokenizer file.

    Built on the driver by :func:`load_tables`, pickled to the workers.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(content)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a BPE file without unknown token and byte fallback is needed")
        self.content = content
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_ids = {t["id"] for t in spec["added_tokens"] if t["special"]}
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        signs = byte_alphabet()
        self.inner = [self.vocab[s] for s in signs]
        self.last = [self.vocab[s + self.suffix] for s in signs]
        self.ranks: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, (a, b) in enumerate(self.merges):
            self.ranks.setdefault(self.vocab[a] << 32 | self.vocab[b], rank)
            self.joined.append(self.vocab[a + b])
        self.lookahead = sufficient_lookahead(self.merges, self.suffix)
        self._newer_characters(Tokenizer.from_str(content.decode()))

    def _newer_characters(self, library) -> None:
        """Letters, digits and lower-case forms that Python's tables don't have yet.

        The library may follow a later Unicode version. It is asked about the
        code points that Python calls unassigned.
        """
        kinds: dict[str, list[int]] = {"letters": [], "numbers": [], "others": []}
        self.lower: dict[str, str] = {}
        split, normal = library.pre_tokenizer.pre_tokenize_str, library.normalizer.normalize_str
        known = regex.compile(r"(?P<letters>\p{L})|(?P<numbers>\p{N})|(?P<others>.)", regex.S)
        for point in range(0x40000):
            sign = chr(point)
            if unicodedata.category(sign) != "Cn":
                continue
            if (small := normal(sign)) != sign:
                self.lower[sign] = small
            if len(split(f"a{small}")) == 1:
                kind = "letters"
            else:
                kind = "numbers" if len(split(f"{small}{small}")) == 2 else "others"
            if known.match(sign).lastgroup != kind:
                kinds[kind].append(point)
        self.classes = {kind: _ranges(points) for kind, points in kinds.items()}

    @cached_property
    def patterns(self) -> dict[str, regex.Pattern]:
        """The splitting rule of the file (fixed by it), and runs of one class."""
        own = self.classes
        letter = rf"[[\p{{L}}{own['letters']}]--[{own['numbers']}{own['others']}]]"
        number = rf"[[\p{{N}}{own['numbers']}]--[{own['letters']}{own['others']}]]"
        other = rf"[[^\s\p{{L}}\p{{N}}{own['letters']}{own['numbers']}]||[{own['others']}]]"
        if not any(own.values()):
            letter, number, other = r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"
        parts = r"'s|'t|'re|'ve|'m|'ll|'d|"
        return {
            "rare": re.compile(f"[{''.join(own.values())}]" if any(own.values()) else r"\b\B"),
            "newer": re.compile(f"[{''.join(self.lower)}]" if self.lower else r"\b\B"),
            "plain": regex.compile(parts + r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
            "words": regex.compile(f"{parts}{letter}+|{number}|{other}+", regex.V1),
            "letters": regex.compile(f"{letter}+", regex.V1),
            "others": regex.compile(f"{other}+", regex.V1),
            "special": regex.compile(
                "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len)[::-1]) + ")"
            ),
        }

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a normal text; the plain rule where no class differs."""
        rare = not text.isascii() and self.patterns["rare"].search(text)
        return self.patterns["words" if rare else "plain"].findall(text)

    def chunks(self, text: str) -> list[str]:
        """Normal text cut at white space, which no pre-token spans.

        The information separators, at which Python cuts too, are no white space here.
        """
        if any(s in text for s in "\x1c\x1d\x1e\x1f"):
            return self.words(text)
        return text.split()

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of a piece between white space."""
        words = self.words(chunk)
        if len(words) == 1:
            return whole_word(self, words[0])
        return [i for w in words for i in whole_word(self, w)]

    @cached_property
    def tokens(self) -> list[str | None]:
        """The text of each id as the file has it."""
        out: list[str | None] = [None] * self.size
        for text, i in [*self.vocab.items(), *self.special.items()]:
            out[i] = text
        return out

    @cached_property
    def token_bytes(self) -> list[bytes]:
        """What each id stands for; the end of a word is a space."""
        value = {s: b for b, s in enumerate(byte_alphabet())}
        out = []
        for i, text in enumerate(self.tokens):
            if text is None or i in self.special_ids:
                out.append((text or "").encode())
                continue
            ends = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if ends else text
            out.append(bytes(value[s] for s in body) + b" " * ends)
        return out

    def normal(self, text: str) -> str:
        """Composed and lower-cased character by character, as the file asks.

        White space needs no change: the splitting rule drops it.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def word_bytes(self, word: str) -> bytes:
        if not word.isascii() and self.patterns["newer"].search(word):
            word = "".join([self.lower.get(s, s) for s in word])
        return word.encode("utf-8", "replace")

    def symbols(self, data: bytes, ends: bool) -> list[int]:
        ids = [self.inner[b] for b in data]
        if ends and ids:
            ids[-1] = self.last[data[-1]]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """The ids after all merges, lowest rank first and leftmost of equal ones."""
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, joined, none = self.ranks.get, self.joined, len(self.joined)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) < none:
            i = ranks.index(rank)
            ids[i : i + 2] = [joined[rank]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        get, ids = self.ranks.get, list(ids)
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        queue = []
        for i in range(len(ids) - 1):
            if (rank := get(ids[i] << 32 | ids[i + 1])) is not None:
                queue.append((rank, i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.joined[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(queue, (r, left))
        return [i for i in ids if i >= 0]


def sufficient_lookahead(merges: list[tuple[str, str]], suffix: str = "") -> int:
    """Bytes after which a token can no longer be changed by what follows.

    Compare the merges of a text with those of the text and a continuation, in
    order of rank. Left of some border both are the same. The border moves left
    only when in one of them the token u before it joins what follows, by a
    rule (u, x). After that u is the start of the token behind the border, so
    the next such rule (v, y) has a later rank and a right side y that starts
    with u. The bound is the longest such chain, in bytes of its left sides. A
    rule must come after those that make its parts, which is checked.
    """
    made, best, bound = set(), {}, 0
    for left, right in merges:
        for part in (left, right):
            if len(part.removesuffix(suffix) if suffix else part) > 1 and part not in made:
                raise ValueError(f"no earlier rule makes {part!r}")
        made.add(left + right)
        body = right.removesuffix(suffix) if suffix else right
        chain = len(left) + max((best.get(body[:k], 0) for k in range(1, len(body) + 1)), default=0)
        best[left] = max(best.get(left, 0), chain)
        bound = max(bound, chain)
    return bound


class WordTransducer:
    """Ids of one pre-token of any length, from its bytes in pieces.

    Holds at most ``window`` bytes and a piece. An id is given out when at least
    the sufficient lookahead follows it.
    """

    def __init__(self, tables: Tables, window: int | None = None):
        self.tables = tables
        self.window = max(window or 0, 2 * tables.lookahead + 64)
        self.widths = None
        self.held = b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for start in range(0, len(data), self.window):
            self.held += data[start : start + self.window]
            if len(self.held) > self.window:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """The ids of the part that no continuation changes; the last byte may still end the word."""
        known = self.tables.symbols(self.held[:-1], False)
        limit, end, out = len(known) - self.tables.lookahead, 0, []
        for i in self.tables.merge(known):
            width = len(self.tables.token_bytes[i])
            if end + width > limit:
                break
            out.append(i)
            end += width
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        data, self.held = self.held, b""
        return self.tables.merge(self.tables.symbols(data, True))


def whole_word(tables: Tables, word: str) -> list[int]:
    """Ids of one pre-token, through the transducer."""
    data = tables.word_bytes(word)
    if len(data) <= 2 * tables.lookahead + 64:
        return tables.merge(tables.symbols(data, True))
    run = WordTransducer(tables)
    return run.feed(data) + run.finish()


_SECONDS: set[str] = set()


def _may_join_left(sign: str) -> bool:
    """Whether composition can change this character together with those before it."""
    if not _SECONDS:
        for point in range(0x110000):
            parts = unicodedata.decomposition(chr(point)).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                _SECONDS.add(chr(int(parts[1], 16)))
        _SECONDS.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    first = unicodedata.normalize("NFD", sign)[0]
    return unicodedata.combining(first) != 0 or first in _SECONDS


class Splitter:
    """Pre-tokens of a text given in pieces.

    ``feed`` returns a list of str (one or more whole pre-tokens without white
    space between them), int (the id of a special
    string in the text) and (part, ends) pairs, the parts of a pre-token that
    is too long to be held. Held between calls: less than ``limit`` characters
    and a piece, as long as the text has a place where composition can't join.
    """

    def __init__(self, tables: Tables, limit: int = 4096):
        self.tables, self.limit = tables, limit
        self.raw = self.text = ""
        self.open: str | None = None

    def feed(self, piece: str, last: bool = False) -> list:
        raw = self.raw + piece
        cut = len(raw) if last else self._cut(raw)
        ready, self.raw = raw[:cut], raw[cut:]
        special = self.tables.patterns["special"]
        if "<" not in ready or len(parts := special.split(ready)) == 1:
            return self._segment(ready, last)
        out: list = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.tables.special[part])
            else:
                out += self._segment(part, last or i < len(parts) - 1)
        return out

    def _cut(self, raw: str) -> int:
        cut = len(raw) - 1
        while cut > 0 and not raw[cut].isascii() and _may_join_left(raw[cut]):
            cut -= 1
        cut = max(cut, 0)
        for k in range(min(cut, max(map(len, self.tables.special))), 0, -1):
            if any(s.startswith(raw[cut - k : cut]) for s in self.tables.special):
                return cut - k
        return cut

    def _segment(self, raw: str, closed: bool) -> list:
        patterns, out = self.tables.patterns, []
        text = self.text + self.tables.normal(raw)
        self.text = ""
        if self.open:
            found = patterns[self.open].match(text)
            end = found.end() if found else 0
            ends = closed or end < len(text)
            out.append((text[:end], ends))
            if not ends:
                return out
            self.open, text = None, text[end:]
        if closed:
            out += self.tables.chunks(text)
            return out
        keep = max(text.rfind(" "), text.rfind("\n")) + 1
        if len(text) - keep < self.limit:
            self.text = text[keep:]
            out += self.tables.chunks(text[:keep])
            return out
        found = list(patterns["words"].finditer(text))
        hold = len(found)
        while hold and found[hold - 1].end() > len(text) - 3:
            hold -= 1
        out += [m.group() for m in found[:hold]]
        if hold == len(found) - 1 and len(rest := found[hold].group()) > 16:
            if found[hold].end() == len(text):
                self.open = "letters" if patterns["letters"].match(rest) else "others"
                out.append((rest, False))
                return out
        self.text = text[found[hold].start() :] if hold < len(found) else ""
        return out


def load_tables(path: str | None = None) -> Tables:
    """Read a tokenizer file (driver side)."""
    with open(path or default_path(), "rb") as file:
        return Tables(file.read())
