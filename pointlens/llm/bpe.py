"""BPE encoding and decoding by speculate and verify.

A word's tokens are proposed by greedy longest match in the vocabulary. The proposal is the true encoding exactly if no
merge could have joined two neighbouring tokens while either was being built, which a vectorised check tests for all
adjacent pairs of all new words of a slice of texts at once. Only words with a failing pair are merged exactly.

All steps work on arrays. A slice of texts is cut at single spaces, and each different piece is encoded once: a place before
a single space that stands between visible characters is a cut of the word pattern, too. Pieces around other white space
are joined again and go through the pattern together, with the same result. A task keeps the ids of pieces that it has met, in two
generations, so that those that come again stay.

Defined cases: a null text counts as empty and has no tokens; the strings of special tokens in a text become their
ids; repeated rows are encoded each; an empty table gives an empty result; other columns are ignored. A tokenizer file that asks for
more than this (a normalizer, a prefix space, another word pattern, ...) raises an error.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlens.llm.common import text_slices

SLICE_BYTES = 1 << 20
CACHE_PIECES = 120_000  # of a generation; bounds the memory of a task
LONG_WORD = 64  # bytes from which a word is treated by itself
MERGE_ROWS = 1 << 11
_NEVER = np.int64(1 << 40)

#: Fixed value: the published word pattern of byte-level BPE.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that a vocabulary file writes for each byte: itself where it is visible, else the next free code point from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _check_supported(spec: dict) -> None:
    """Raises ValueError for a file that is more than byte-level BPE with the published pattern."""
    cut, kind = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    plain &= kind.get("type", "BPE") == "BPE" and not any(kind.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain &= (spec.get("decoder") or {}).get("type") == "ByteLevel"
    plain &= not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        raise ValueError("only byte-level BPE without normalizer, prefix space and other extras is supported")


@dataclass
class BpeModel:
    """tokens: id to bytes. ranks: pair of ids to (rank, merged id). special: text to id."""

    tokens: dict[int, bytes]
    ranks: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    digest: str = ""

    @classmethod
    def load(cls, path: str) -> BpeModel:
        """Read a byte-level tokenizer file on the driver; what it holds goes to the tasks with the closure's broadcast."""
        with open(path, "rb") as f:
            data = f.read()
        spec = json.loads(data)
        _check_supported(spec)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        tokens = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        ranks = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks[vocab[left], vocab[right]] = (rank, vocab[left + right])
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        return cls(tokens | {i: t.encode() for t, i in special.items()}, ranks, special, sha256(data).hexdigest())


class CodeTable:
    """Finds the place of 64-bit codes in a list without repeats (-1: not there), many at a time: hashing with linear probing."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(8, int(8 * len(codes)).bit_length())
        self.codes = np.full(1 << self.bits, -1, np.int64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(codes))
        at = self._slots(codes)
        while len(todo):
            free = np.flatnonzero(self.codes[at[todo]] < 0)
            _, first = np.unique(at[todo[free]], return_index=True)  # one code for a slot
            placed = todo[free[first]]
            self.codes[at[placed]], self.places[at[placed]] = codes[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self._slots(codes)
        held = self.codes[at]
        out = np.where(held == codes, self.places[at], np.int32(-1))
        more = np.flatnonzero((held != codes) & (held >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            held = self.codes[at[more]]
            found = held == codes[more]
            out[more[found]] = self.places[at[more[found]]]
            more = more[~found & (held >= 0)]
        return out


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of consecutive groups of the given sizes."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class Encoder:
    """Works on a BpeModel inside a task."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.pattern = regex.compile(WORD_PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(model.special, key=len, reverse=True))) + ")") if model.special else None
        ordinary = {i: t for i, t in model.tokens.items() if i not in model.special.values()}
        self.of_byte = {t[0]: i for i, t in ordinary.items() if len(t) == 1}
        self.byte_ids = np.array([self.of_byte.get(b, -1) for b in range(256)], np.int64)
        size = max(model.tokens) + 1
        self.size = size
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.built = np.full(size, -1, np.int64)  # rank of the merge that builds a token, -1 for a byte
        twice = set()
        for (a, b), (rank, c) in model.ranks.items():
            if self.built[c] >= 0:
                twice.add(c)
            self.left[c], self.right[c], self.built[c] = a, b, rank
        self.pairs = CodeTable(np.fromiter((a * size + b for a, b in model.ranks), np.int64, len(model.ranks)))
        self.pair_rank = np.fromiter((*(r for r, _ in model.ranks.values()), _NEVER), np.int64)  # the last one is what -1 finds
        self.pair_token = np.fromiter((*(c for _, c in model.ranks.values()), -1), np.int64)
        # Only tokens that are the encoding of their own bytes may be proposed: bytes, and merges whose halves fit together.
        built = [i for i, t in ordinary.items() if len(t) > 1 and self.built[i] >= 0 and i not in twice]
        fits = self._fit(self.left[built], self.right[built], self.built[built])
        self.proposed = {ordinary[i]: i for i, ok in zip(built, fits) if ok} | {bytes([b]): i for b, i in self.of_byte.items()}
        self.longest = max(map(len, self.proposed), default=1)
        self._build_trie()
        texts = [model.tokens.get(i, b"") for i in range(size)]
        self.token_texts = pa.array(texts, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.young: dict[str, bytes | None] = {}  # ids of what follows a space, None for what cannot be cut there
        self.old: dict[str, bytes | None] = {}
        self.merged = 0  # words that needed exact merging

    def _build_trie(self) -> None:
        """Nodes of the tokens that may be proposed: `steps` finds the node behind (node, byte), `ends` has the token of a node."""
        nodes, tokens = {b"": 0}, [-1]
        codes = []
        for text, token in sorted(self.proposed.items()):
            for n in range(1, len(text) + 1):
                if text[:n] not in nodes:
                    codes.append(nodes[text[: n - 1]] * 256 + text[n - 1])
                    nodes[text[:n]] = len(tokens)
                    tokens.append(-1)
            tokens[nodes[text]] = token
        self.steps, self.ends = CodeTable(np.array(codes, np.int64)), np.array(tokens, np.int64)  # node n + 1 belongs to code n

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.pair_rank[self.pairs.find(a * self.size + b)]

    def _fit(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins a and b across their border while they are built (before rank `until`, if given).

        Both tokens are taken apart, latest merge first. In a state with x at the end of what is left of a and y at the
        start of what is left of b, the pair (x, y) merges first if its rank is below that of the merge that takes
        x and not above that of the one that takes y (of equal ranks the left one goes first).
        """
        n = len(a)
        good = np.ones(n, bool)
        live = np.arange(n)
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_taken = np.full(n, _NEVER) if until is None else until.astype(np.int64).copy()
        y_taken = x_taken.copy() if until is None else x_taken - 1
        while len(live):
            rank = self._rank(x, y)
            bad = (rank < x_taken) & (rank <= y_taken)
            good[live[bad]] = False
            rx, ry = self.built[x], self.built[y]
            go = ~bad & (np.maximum(rx, ry) >= 0)
            live, x, y, x_taken, y_taken, rx, ry = (v[go] for v in (live, x, y, x_taken, y_taken, rx, ry))
            of_x = rx > ry
            x_taken, y_taken = np.where(of_x, rx, x_taken), np.where(of_x, y_taken, ry)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
        return good

    def _propose_long(self, word: bytes) -> list[int]:
        out, at, n, get = [], 0, len(word), self.proposed.get
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                token = get(word[at:end])
                if token is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, of equal ones the leftmost."""
        ids = [self.of_byte[b] for b in word]
        n, ranks = len(ids), self.model.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(ranks[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in ranks:
                    heapq.heappush(heap, (ranks[p][0], k, *p))
        return [t for t in ids if t >= 0]

    def _propose(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of the words data[start:end]: word and token of each proposal, words in ascending order."""
        word = np.flatnonzero(start < end)
        at, stop = start[word], end[word]
        node, best, best_end = np.zeros(len(word), np.int64), np.full(len(word), -1), at.copy()
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            inside = at < stop
            step = self.steps.find(node * 256 + data[np.where(inside, at, 0)])
            on = inside & (step >= 0)
            node = np.where(on, step + 1, 0)
            at = np.where(on, at + 1, best_end)
            token = self.ends[node]
            best, best_end = np.where(on & (token >= 0), token, best), np.where(on & (token >= 0), at, best_end)
            off = ~on
            if off.any():
                out.append((word[off], best[off]))
                best[off] = -1
                live = at < stop
                live |= on
                if not live.all():
                    word, at, stop, node, best, best_end = (v[live] for v in (word, at, stop, node, best, best_end))
        words, tokens = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def _merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of the words data[start:end], rows of a table: lengths, and the tokens of all words in a row."""
        counts = np.zeros(len(start), np.int64)
        by_size = np.argsort(end - start, kind="stable")
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(by_size), MERGE_ROWS):
            row = by_size[first : first + MERGE_ROWS]
            width = int((end[row] - start[row]).max())
            place = np.arange(width)
            held = place < (end[row] - start[row])[:, None]
            ids = np.where(held, self.byte_ids[data[np.where(held, start[row][:, None] + place, 0)]], -1)
            ranks = np.full((len(row), width), _NEVER)  # of a token and its right neighbour
            y, x = np.nonzero(held[:, 1:])
            ranks[y, x] = self._rank(ids[y, x], ids[y, x + 1])
            while len(row):
                at = ranks.argmin(axis=1)
                every = np.arange(len(row))
                go = ranks[every, at] < _NEVER
                if not go.all():
                    y, x = np.nonzero(ids[~go] >= 0)
                    counts[row[~go]] = np.bincount(y, minlength=len(row) - int(go.sum()))
                    done.append((row[~go][y], x, ids[~go][y, x]))
                    row, ids, ranks, at = row[go], ids[go], ranks[go], at[go]
                    if not len(row):
                        break
                    every = np.arange(len(row))
                ids[every, at] = self.pair_token[self.pairs.find(ids[every, at] * self.size + ids[every, at + 1])]
                # what is right of the pair moves up by one
                source = np.minimum(place + (place > at[:, None]), width - 1)
                ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
                ids[:, -1], ranks[:, -1] = -1, _NEVER
                for k in (at - 1, at):
                    near = np.flatnonzero((k >= 0) & (k + 1 < width))
                    right = np.where(k[near] + 1 < width, ids[near, np.minimum(k[near] + 1, width - 1)], -1)
                    ranks[near, k[near]] = np.where(right >= 0, self._rank(ids[near, k[near]], np.maximum(right, 0)), _NEVER)
        if not done:
            return counts, np.zeros(0, np.int64)
        row, x, ids = (np.concatenate(v) for v in zip(*done))
        return counts, ids[np.lexsort((x, row))]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all their ids in a row."""
        held = pa.array(words, pa.large_string())
        ends = np.frombuffer(held.buffers()[1], np.int64, len(words) + 1) if words else np.zeros(1, np.int64)
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8) if words else np.zeros(0, np.uint8)
        start, end = ends[:-1], ends[1:]
        single = {i: [self.model.special[w]] for i, w in enumerate(words) if w in self.model.special}
        single |= {i: None for i in np.flatnonzero(end - start > LONG_WORD).tolist() if i not in single}
        usual = np.setdiff1d(np.arange(len(words)), np.fromiter(single, np.int64, len(single)), assume_unique=True)

        owner, tokens = self._propose(data, start[usual], end[usual])
        owner = usual[owner]
        for i, ids in single.items():
            if ids is None:
                single[i] = self._propose_long(words[i].encode())
        if single:
            owner = np.concatenate([owner, np.repeat(np.fromiter(single, np.int64), [len(t) for t in single.values()])])
            tokens = np.concatenate([tokens, np.fromiter((t for ids in single.values() for t in ids), np.int64)])
            order = np.argsort(owner, kind="stable")
            owner, tokens = owner[order], tokens[order]
        # verify every adjacent pair
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        codes, back = np.unique(tokens[inner] * self.size + tokens[inner + 1], return_inverse=True)
        fits = self._fit(codes // self.size, codes % self.size)[back]
        failing = np.unique(owner[inner[~fits]])
        self.merged += len(failing)
        counts = np.bincount(owner, minlength=len(words))
        if len(failing):
            long = [i for i in failing.tolist() if end[i] - start[i] > LONG_WORD]
            short = np.setdiff1d(failing, long, assume_unique=True)
            keep = ~np.isin(owner, failing)
            new_counts, new = self._merge(data, start[short], end[short])
            merged = {i: self._merge_long(words[i].encode()) for i in long}
            counts[short] = new_counts
            counts[long] = [len(t) for t in merged.values()]
            owner = np.concatenate([owner[keep], np.repeat(short, new_counts), np.repeat(np.array(long, np.int64), counts[long])])
            tokens = np.concatenate([tokens[keep], new, np.fromiter((t for ids in merged.values() for t in ids), np.int64)])
            tokens = tokens[np.argsort(owner, kind="stable")]
        return counts, tokens

    def _by_words(self, words: list[str], counts: np.ndarray) -> list[bytes]:
        """Ids of pieces that are made of consecutive words, so many each, as bytes of little-endian int32."""
        number: dict[str, int] = {}
        of = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
        sizes, ids = self.encode_words(list(number))
        begin = np.cumsum(sizes) - sizes
        mine = sizes[of]
        data = ids[np.repeat(begin[of], mine) + _spread(mine)].astype("<i4").tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(mine)]))[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[s:e] for s, e in zip(ends, ends[1:])]

    def _cut(self, text: str) -> list[str]:
        """Words of any text by the pattern, special tokens among them."""
        parts = self.special.split(text) if self.special else [text]
        return [w for part in parts for w in ([part] if part in self.model.special else self.pattern.findall(part))]

    def _learn(self, pieces: list[str]) -> None:
        """Take up pieces that follow a space."""
        plain = [p for p in pieces if p and not p[0].isspace() and not p[-1].isspace()]
        self.young.update(dict.fromkeys(set(pieces).difference(plain)))
        known = [p for p in plain if p.isalpha()]  # one word each
        other = [p for p in plain if not p.isalpha()]
        joined = " " + " ".join(other)
        if any(s in joined for s in self.model.special):
            cut = [self._cut(" " + p) for p in other]
            words, counts = [w for c in cut for w in c], [len(c) for c in cut]
        else:
            words = self.pattern.findall(joined) if other else []
            begins = np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words)))  # a piece holds no other space
            counts = np.diff(np.append(begins, len(words))).tolist()
        single = [p for p in known if p not in self.model.special]
        special = [p for p in known if p in self.model.special]
        words += [" " + p for p in single] + [w for p in special for w in self._cut(" " + p)]
        counts += [1] * len(single) + [len(self._cut(" " + p)) for p in special]
        self.young.update(zip(other + single + special, self._by_words(words, np.array(counts, np.int64))))

    def _look_up(self, pieces: list[str]) -> list[bytes | None]:
        young, old = self.young, self.old
        new = []
        for p in pieces:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    new.append(p)
        if new:
            self._learn(new)
        found = [*map(young.__getitem__, pieces)]
        if len(young) > CACHE_PIECES:
            self.young, self.old = {}, young
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a LargeBinary or LargeString array without nulls."""
        texts = texts.cast(pa.large_string())
        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy().astype(np.int64)
        flat = cut.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        coded = pc.dictionary_encode(flat)
        at = coded.indices.to_numpy().astype(np.int64)
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        entries = self._look_up(pieces)
        nothing = len(entries)
        entries.append(b"")

        # Runs of pieces that belong together, and the first piece of each text, are cut by the pattern themselves.
        odd = [i for i, e in enumerate(entries) if e is None]
        opens, closes = np.zeros(nothing, bool), np.zeros(nothing, bool)
        for i in odd:
            entries[i] = b""
            opens[i], closes[i] = not pieces[i] or pieces[i][0].isspace(), not pieces[i] or pieces[i][-1].isspace()
        with_previous = opens[at]
        with_previous[1:] |= closes[at[:-1]]
        first = np.zeros(len(at), bool)
        first[ends[:-1]] = True
        with_previous &= ~first
        heads = np.flatnonzero(~with_previous)
        length = np.diff(np.append(heads, len(at)))
        own = np.flatnonzero(first[heads] | (length > 1) | opens[at[heads]] | closes[at[heads]])
        whole = ["" if first[h] else " " for h in heads[own]]
        whole = [lead + " ".join([pieces[i] for i in at[h : h + n]]) for lead, h, n in zip(whole, heads[own], length[own])]
        at[with_previous] = nothing
        at[heads[own]] = len(entries) + np.arange(len(own))
        words = [self._cut(w) for w in whole]
        entries += self._by_words([w for ws in words for w in ws], np.array([len(ws) for ws in words], np.int64))

        taken = pa.array(entries, pa.large_binary()).take(pa.array(at))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(at) + 1)
        ids = np.frombuffer(taken.buffers()[2] or b"", "<i4")
        stops = (offsets[ends] // 4).tolist()
        return [ids[s:e] for s, e in zip(stops, stops[1:])]

    def _strung(self, strings: pa.Array, ids: list[np.ndarray]) -> list[memoryview]:
        """For each text, its ids' strings in a row."""
        taken = strings.take(pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        offsets = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        stops = offsets[np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [data[s:e] for s, e in zip(stops, stops[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        return [str(data, "utf-8", "replace").encode() for data in self._strung(self.token_texts, ids)]

    def id_texts(self, ids: list[np.ndarray]) -> list[memoryview]:
        """Decimal ids joined by commas."""
        return [data[:-1] for data in self._strung(self.decimals, ids)]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array of int) and decoded (the text that the ids stand for). tokenizer: path of a byte-level tokenizer file on the driver."""
    return _run(docs, tokenizer, id_col, text_col, "ids array<int>, decoded string", _whole)


def encode_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: encode() with its outputs digested where they arise."""
    return _run(docs, tokenizer, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digested)


def _whole(encoder: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32())), pa.array([d.decode() for d in encoder.decode(ids)], pa.string())]


def _digested(encoder: Encoder, ids: list[np.ndarray]) -> list[pa.Array]:
    return [
        pa.array([len(i) for i in ids], pa.int64()),
        pa.array([sha256(t).hexdigest() for t in encoder.id_texts(ids)], pa.string()),
        pa.array([sha256(t).hexdigest() for t in encoder.decode(ids)], pa.string()),
    ]


def _run(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, outputs: str, make) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(BpeModel.load(tokenizer))
    names = [c.split()[0] for c in outputs.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            for part, texts in text_slices(batch, "_text", SLICE_BYTES):
                encoder = encoder or Encoder(model.value)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *make(encoder, encoder.encode(texts))], [id_col, *names])
        encoder = None
        pa.default_memory_pool().release_unused()  # for the tasks of other stages that this worker may get

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(each, f"`{id_col}` {kind}, {outputs}")
