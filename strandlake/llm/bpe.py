"""BPE encoding and decoding with a bounded-lookahead streaming transducer.

Whether a token is final depends on what follows only through a chain of merges, each of which could take part of a token away
from the one before it, and so must come earlier in the merge list: a merge (u, v) is undone only if v, or a part on v's right-hand side, is
first taken by an earlier merge (s, w), and that in turn only by one still earlier that begins inside w. The longest such chain, added up
over the merge list, bounds the characters to look ahead (`Bpe.lookahead`): a token that ends so far before the end of what has been
read can no longer change. Every word goes through the transducer: it takes symbols one after the other into a buffer of four lookaheads;
when the buffer is full, tokens that are stable leave and the rest stays, and when the word ends, what is left leaves; so memory is constant at any
word length. Texts are cut into words first; each task keeps the codes of words and runs that it has met, up to a fixed number.

Decoding reads ids alone, one after the other: a decoder holds what has to be known between two ids (whether a token came before, and at
most three bytes of an unfinished character), and puts out text. For readable text the tokens' bytes go through an incremental UTF-8
state machine; bytes that form no character give U+FFFD.

Null text: empty, no tokens. Very long texts and words: whole. Ids that the vocabulary lacks decode to nothing. Repeated rows each get a
row; an empty table gives none; other columns are kept (own ones named n_tokens, ids and decoded are replaced).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandlake.llm.common import map_texts

#: White space as the vocabulary's splitter has it (Unicode White_Space).
BLANK = "\t-\r \x85\xa0  -     　"
#: Words, and runs, whose codes a task keeps; ids that are decoded at once.
MOST_KEPT, PART = 200_000, 1 << 16


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 stands for itself, the others for letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A vocabulary file's merges, pattern and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.lookahead = self._lookahead(pairs)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        blank = f"[{BLANK}]"
        self.blank = re.compile(f"{blank}+")
        self.words = regex.compile(pattern.replace(r"[^\s", f"[^{BLANK}"))
        # the same words where the text is ASCII, with a faster engine
        self.ascii_words = re.compile(pattern.replace(r"[\p{L}]", "[a-zA-Z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", "[^\t-\r a-zA-Z0-9]"))
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        #: Control characters that str.split() takes for blanks and the vocabulary doesn't.
        self.plain = re.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    @staticmethod
    def _lookahead(pairs: list[tuple[str, str]]) -> int:
        """Longest reach of a chain of merges in which each next one comes earlier in the list and begins with what ends the last one's right part.

        reach(u, v) = len(v) + the greatest reach of earlier merges (s, w) where s is v or one of the parts on v's right edge."""
        made: dict[str, tuple[str, ...]] = {}
        best: dict[str, int] = {}
        longest = 0
        for u, v in pairs:
            edge = made.get(v, (v,))
            reach = len(v) + max((best.get(s, 0) for s in edge), default=0)
            best[u] = max(best.get(u, 0), reach)
            made.setdefault(u + v, (u + v, *edge))
            longest = max(longest, reach)
        return longest + max((len(u + v) for u, v in pairs), default=1)

    def normal(self, text: str) -> str:
        if not text.isascii():
            # lower case letter by letter: sigma has no final form here
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.lower()

    def merged(self, parts: list[str]) -> list[str]:
        """Merge the neighbours whose merge comes first in the list, leftmost first, until no neighbours have one."""
        rank, none = self.rank.get, 1 << 30
        ranks = [rank(p, none) for p in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i : i + 2] = (new := parts[i] + parts[i + 1],)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], new), none)
            if i < len(ranks):
                ranks[i] = rank((new, parts[i + 1]), none)
        return parts

    def stream(self, parts):
        """Tokens of one word from parts of its symbols, each token as soon as it is stable."""
        machine = Transducer(self)
        for part in parts:
            yield from machine.push(part)
        yield from machine.finish()

    def symbols(self, word: str):
        """The letters of the word's bytes, the last with the end mark, in parts of bounded size."""
        size = 4 * self.lookahead
        for at in range(0, len(word), size):
            part = list(map(self.letters.__getitem__, word[at : at + size].encode("utf-8", "surrogatepass")))
            if at + size >= len(word):
                part[-1] += self.end
            yield part

    def encode_word(self, word: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        got = self.known.get(word)
        if got is None:
            ids = self.ids
            got = array("I", [ids[p] for p in self.stream(self.symbols(word)) if p in ids]).tobytes()
            if len(self.known) >= MOST_KEPT:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = got
        return got

    def encode_run(self, run: str) -> bytes:
        """encode_word() for each word of a run without blanks."""
        out = b"".join([self.encode_word(w) for w in (self.ascii_words if run.isascii() else self.words).findall(run)])
        if len(self.runs) >= MOST_KEPT:
            self.runs.clear()
        if len(run) <= 64:
            self.runs[run] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """A text's ids (little-endian 32-bit); special tokens' strings become their ids."""
        ids = []
        known, one = self.runs, self.encode_run
        for i, piece in enumerate(self.split_special.split(text or "") if self.split_special else [text or ""]):
            if i % 2:
                ids.append(struct.pack("<I", self.special[piece]))
                continue
            piece = self.normal(piece)
            # runs between blanks are looked up first; only new ones are cut into words
            runs = piece.split() if self.plain.search(piece) is None else self.blank.split(piece)
            ids += [known.get(r) or one(r) for r in runs if r]
        return b"".join(ids)

    def decode(self, ids: bytes) -> str:
        """As the library joins tokens where a vocabulary has no decoder: by blanks, in the alphabet of bytes. ids as encode() gives them."""
        machine = Decoder(self)
        return "".join([machine.push(ids[at : at + 4 * PART]) for at in range(0, len(ids), 4 * PART)])

    def text(self, ids: bytes) -> str:
        """Readable text: tokens' bytes through the UTF-8 machine, word ends as blanks."""
        machine, out = Utf8(), []
        for i in array("I", ids):
            token = self.tokens.get(i, "")
            if token in self.special:
                out.append(machine.flush() + token)
                continue
            ends = bool(self.end) and token.endswith(self.end)
            body = token[: -len(self.end)] if ends else token
            out.append(machine.push(bytes(self.bytes[c] for c in body)))
            if ends:
                out.append(machine.flush() + " ")
        return "".join(out) + machine.flush()


class Transducer:
    """Symbols in, stable tokens out. The state is a buffer of at most four lookaheads."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.held, self.size = bpe, [], 4 * bpe.lookahead

    def push(self, symbols: list[str]) -> list[str]:
        """Take at most `size` symbols; the tokens that can no longer change."""
        out = []
        while symbols:
            take = self.size - len(self.held)
            self.held, symbols = self.held + symbols[:take], symbols[take:]
            if len(self.held) < self.size:
                break
            at = 0
            for t in self.bpe.merged(self.held[:]):
                # the end mark is no symbol of its own, so a token's symbols are its letters until the word's end
                if at + len(t) > len(self.held) - self.bpe.lookahead:
                    break
                at += len(t)
                out.append(t)
            self.held = self.held[at:]
        return out

    def finish(self) -> list[str]:
        held, self.held = self.held, []
        return self.bpe.merged(held)


class Decoder:
    """Ids in, text out; the state is whether a token came before."""

    def __init__(self, bpe: Bpe):
        self.tokens, self.begun = bpe.tokens, False

    def push(self, ids: bytes) -> str:
        known, read = self.tokens, array("I", ids)
        try:
            found = list(map(known.__getitem__, read))
        except KeyError:
            found = [known[i] for i in read if i in known]
        if not found:
            return ""
        ahead, self.begun = " " if self.begun else "", True
        return ahead + " ".join(found)


class Utf8:
    """Incremental bytes to text: holds at most three bytes of an unfinished character."""

    def __init__(self):
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def push(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.value, self.low, self.high, self.need = self.value << 6 | b & 0x3F, 0x80, 0xBF, self.need - 1
                    if not self.need:
                        out.append(chr(self.value))
                    continue
                out.append(self.flush())
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.value, self.low, self.high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.value, self.low, self.high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def flush(self) -> str:
        lost, self.need, self.low, self.high = self.need, 0, 0x80, 0xBF
        return "�" if lost else ""


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """A worker loads a vocabulary once."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids (binary, little-endian 32-bit) and decoded (what decode() makes of the ids). path must exist on every worker."""
    others = [c for c in docs.columns if c not in ("n_tokens", "ids", "decoded")]

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                got = [bpe.encode(t.as_py()) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(got, pa.binary()), pa.array(list(map(bpe.decode, got)), pa.string())], names=[*others, "n_tokens", "ids", "decoded"])

    kept = docs.select(*others)
    return map_texts(kept, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "n_tokens long, ids binary, decoded string"]))


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of what the decoder makes of them, taken where they arise."""

    def run(batches):
        bpe = loaded(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            size, a, b = [], [], []
            for t in batch.column("text"):
                ids = bpe.encode(t.as_py())
                size.append(len(ids) // 4)
                a.append(sha(ids))
                b.append(sha(bpe.decode(ids).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
