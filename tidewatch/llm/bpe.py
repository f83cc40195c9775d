"""BPE encoding and decoding by speculation and verification.

Every white-space-free chunk that a batch of texts holds is handled once per batch:

0. Plain texts are lower-cased, and punctuation is set apart from the letters before it: no word
   goes across that place, and far fewer different chunks are left.
1. *Speculate*: greedy longest match proposes tokens for each new word.
2. *Verify*: one vectorised check over all adjacent token pairs of all new words. A
   tokenization is the one that the merges give if and only if each token is reachable by
   the merges and no adjacent pair would have been merged across its boundary earlier.
3. *Repair*: only the words with a failing pair are merged exactly.

Texts are then put together from the chunks' ids with array gathers, so a word's cost is
paid once a batch and not once an occurrence. Nothing is shuffled: a text is one row.

Defined results: a null text counts as empty, an empty or blank text has no tokens, texts of
any length are encoded whole, and repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewatch.llm.common import given_back, small_batches, spans

#: Bytes of text that are encoded together, and chunks that a worker remembers.
BATCH_BYTES, REMEMBERED = 2 << 20, 150_000
#: Longer words are merged one by one on a heap.
LONG_WORD = 64
#: Below this code point the fast path normalises by lower-casing alone (NFC changes nothing there).
PLAIN_END, DOTTED_I = 0x250, "İ"
#: Texts with such characters are left to the library's normalizer, chunk by chunk.
BEYOND_PLAIN = r"[^\x00-\x{24F}]|\x{130}"
NEVER = np.int64(1 << 40)
#: Stands behind each word in the trie of tokens; no byte letter.
WORD_END = chr(600)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.tokens = [""] * size
        for token, i in (vocab | self.special).items():
            self.tokens[i] = token
        self.token_array = pa.array(self.tokens, pa.string())
        # the merge that makes each token: its rank (-1: a letter) and its two parts
        self.rank = np.full(size, -1, np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys, ranks = [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            a, b = vocab[a], vocab[b]
            if (a, b) not in self.merges:
                self.merges[a, b] = (rank, made)
                keys.append(a << 32 | b)
                ranks.append(rank)
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, a, b
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.made_by = np.zeros(len(model["merges"]), np.int64)
        for rank, made in self.merges.values():
            self.made_by[rank] = made
        self._index_tokens(vocab)
        split = next(p for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256) if letters[b] != chr(b)}
        self.marks = "|".join(regex.escape(t).replace("<", r"\<") for t in self.special)
        self.odd_row = "[\x1c-\x1f]" + (f"|{self.marks}" if self.marks else "")
        self.mark_split = regex.compile(f"({self.marks})") if self.marks else None
        self._forget()

    @functools.cached_property
    def library(self):
        """The library's tokenizer, whose normalizer takes the rare characters; most workers never load it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.filled = 0

    def _index_tokens(self, vocab: dict[str, int]) -> None:
        """Tokens for longest matching; those that the merges can't reach are never proposed."""
        made = np.flatnonzero(self.rank >= 0)
        reachable = np.ones(len(self.tokens), bool)
        own = self._compatible(self.left[made], self.right[made], self.rank[made])
        own &= (self.rank[self.left[made]] < self.rank[made]) & (self.rank[self.right[made]] < self.rank[made])
        reachable[made] = own
        for i in made[np.argsort(self.rank[made])]:
            reachable[i] &= reachable[self.left[i]] & reachable[self.right[i]]
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        for token, i in vocab.items():
            single = self.rank[i] < 0
            if self.suffix and token.endswith(self.suffix) and token != self.suffix:
                token = token[: -len(self.suffix)]
                if reachable[i] and (not single or len(token) == 1):
                    self.last[token] = i
            elif reachable[i] and (not single or len(token) == 1):
                self.inner[token] = i
        if not self.suffix:
            self.last = self.inner
        self.letter_inner, self.letter_last = np.zeros(512, np.int64), np.zeros(512, np.int64)
        for table, letters in ((self.letter_inner, self.inner), (self.letter_last, self.last)):
            for token, i in letters.items():
                if len(token) == 1:
                    table[ord(token)] = i
        self._plant()
        self.longest_from: dict[str, int] = {}
        for token in self.inner:
            self.longest_from[token[:2]] = max(len(token), self.longest_from.get(token[:2], 1))
        self.longest_last = max(map(len, self.last), default=1)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: would the merges leave the boundary between them alone?

        Both tokens' merges are undone, latest first. At each point of time the two parts that
        touch at the boundary must not have a merge that was due before what was just undone. Of
        equal merges the left one comes first, so undoing on the right allows equality.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), NEVER) if limit is None else limit.astype(np.int64)
        fine = np.ones(len(a), bool)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            clash = self._pair_rank(x, y) < limit[todo]
            fine[todo[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            todo, x, y, rx, ry = (v[~clash & ((rx >= 0) | (ry >= 0))] for v in (todo, x, y, rx, ry))
            undo_left = rx > ry
            a[todo] = np.where(undo_left, self.right[x], x)
            b[todo] = np.where(undo_left, y, self.left[y])
            limit[todo] = np.where(undo_left, rx, ry + 1)
        return fine

    def _plant(self) -> None:
        """The tokens as a trie: sorted keys node * 1024 + letter, their children, and each node's token."""
        children: dict[int, int] = {}
        accept = [-1]
        for ending, table in (("", self.inner), (WORD_END if self.suffix else "", self.last)):
            for token, i in table.items():
                node = 0
                for c in token + ending:
                    node = children.setdefault(node * 1024 + ord(c), len(accept))
                    if node == len(accept):
                        accept.append(-1)
                accept[node] = i
        self.trie_keys = np.array(sorted(children), np.int64)
        self.trie_next = np.array([children[k] for k in self.trie_keys.tolist()], np.int64)
        self.accept = np.array(accept, np.int64)

    def _propose_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words side by side; tokens in order, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer((WORD_END.join(words) + WORD_END).encode("utf-32-le"), np.uint32).astype(np.int64)
        end = np.cumsum(sizes + 1) - 1
        word = np.arange(len(words))
        at = end - sizes
        node, best, token = np.zeros(len(words), np.int64), at.copy(), np.full(len(words), -1)
        out_word, out_token = [], []
        while len(word):
            letter = points[at]
            keys = node * 1024 + letter
            place = np.minimum(np.searchsorted(self.trie_keys, keys), len(self.trie_keys) - 1)
            on = self.trie_keys[place] == keys
            node = np.where(on, self.trie_next[place], node)
            at = at + on
            closing = letter == ord(WORD_END)
            found = self.accept[node]
            # a token inside the word has to leave a letter for one that ends it
            good = on & (found >= 0) & (closing | (at < end))
            best, token = np.where(good, at, best), np.where(good, found, token)
            if (stop := ~on | closing).any():
                out_word.append(word[stop])
                out_token.append(token[stop])
                at, node = np.where(stop, best, at), np.where(stop, 0, node)
                live = ~stop | (best <= end)
                word, at, node, best, token, end = (v[live] for v in (word, at, node, best, token, end))
        owner = np.concatenate(out_word)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(out_token)[order], np.bincount(owner, minlength=len(words))

    def _propose(self, word: str) -> list[int]:
        out, i, n = [], 0, len(word)
        inner, last = self.inner, self.last
        while i < n:
            rest = n - i
            if rest <= self.longest_last and (token := last.get(word[i:])) is not None:
                out.append(token)
                break
            for k in range(min(self.longest_from.get(word[i : i + 2], 1), rest - 1), 0, -1):
                token = inner.get(word[i : i + k])
                if token is not None:
                    out.append(token)
                    i += k
                    break
        return out

    def _merge_together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The merges of many words side by side: in each round every word makes its next merge.
        Returns the tokens and the word that each belongs to, a word's tokens in order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        ids = self.letter_inner[points]
        ids[ends - 1] = self.letter_last[points[ends - 1]]
        of = np.repeat(np.arange(len(words)), sizes)
        out_word, out_token = [], []

        def ranks(at: np.ndarray) -> np.ndarray:
            nxt = np.minimum(at + 1, len(ids) - 1)
            return np.where((of[at] == of[nxt]) & (nxt > at), self._pair_rank(ids[at], ids[nxt]), NEVER)

        due = ranks(np.arange(len(ids)))
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(ids)]]))
            first = np.minimum.reduceat(due, starts)
            done = first == NEVER
            if done.any():
                keep = np.repeat(~done, sizes)
                out_word.append(of[~keep])
                out_token.append(ids[~keep])
                ids, of, due, first, sizes = ids[keep], of[keep], due[keep], first[~done], sizes[~done]
                if not len(ids):
                    break
            hits = np.flatnonzero(due == np.repeat(first, sizes))
            hits = hits[np.concatenate([[True], of[hits][1:] != of[hits][:-1]])]
            ids[hits] = self.made_by[first]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # each earlier word has lost one place
            ids, of, due = ids[keep], of[keep], due[keep]
            due[at] = ranks(at)
            before = at[(at > 0) & (of[at - 1] == of[at])] - 1
            due[before] = ranks(before)
        return np.concatenate(out_token), np.concatenate(out_word)

    def _merge(self, word: str) -> list[int]:
        """The merges themselves, lowest rank first and leftmost of equals, on a linked list."""
        ids = [self.inner[c] for c in word[:-1]] + [self.last[word[-1]]]
        n = len(ids)
        nxt, prev = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prev[k] = i
                if m := self.merges.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := prev[i]) >= 0 and (m := self.merges.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def _lettered(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def _words(self, chunk: str) -> list[str]:
        """A chunk's words, in byte letters."""
        if DOTTED_I not in chunk and max(chunk) < chr(PLAIN_END):
            return [self._lettered(w) for w in self.pattern.findall(chunk.lower())]
        plain = self.library.normalizer.normalize_str(chunk)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each has: proposed, verified, and where need be merged."""
        alone = np.fromiter((len(w) > LONG_WORD or not self.suffix for w in words), bool, len(words))
        together = np.flatnonzero(~alone)
        tokens, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(together):
            some = [words[i] for i in together.tolist()] if alone.any() else words
            flat, sizes = self._propose_together(some)
            of = np.repeat(np.arange(len(some)), sizes)
            inside = np.flatnonzero(of[:-1] == of[1:])
            failed = np.zeros(len(some), bool)
            failed[of[inside[~self._compatible(flat[inside], flat[inside + 1])]]] = True
            good = ~failed[of]
            tokens.append(flat[good])
            owners.append(together[of[good]])
            if failed.any():
                at = np.flatnonzero(failed)
                exact, word = self._merge_together([some[i] for i in at.tolist()])
                tokens.append(exact)
                owners.append(together[at[word]])
        for i in np.flatnonzero(alone).tolist():  # too few or too long for arrays
            plan = np.array(self._propose(words[i]), np.int64)
            if not self._compatible(plan[:-1], plan[1:]).all():
                plan = np.array(self._merge(words[i]), np.int64)
            tokens.append(plan)
            owners.append(np.full(len(plan), i))
        owner = np.concatenate(owners)
        return np.concatenate(tokens)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def _keep(self, chunks: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.known), len(chunks)
        while at + n > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * len(self.lengths)), np.resize(self.starts, 2 * len(self.starts))
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.lengths[at : at + n] = sizes
        self.starts[at : at + n] = self.filled + np.cumsum(sizes) - sizes
        self.filled += len(flat)
        self.known.update(zip(chunks, range(at, at + n), strict=True))

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that aren't known yet, all together. Most are one word of plain letters."""
        single, words, rest = [], [], []
        for c in chunks:
            if c.isalpha() and (c.isascii() or DOTTED_I not in c and max(c) < chr(PLAIN_END)):
                single.append(c)
                words.append(self._lettered(c.lower()))
            else:
                rest.append(c)
        self._keep(single, *self._solve(words))
        if rest:
            made = [self._words(c) if c else [] for c in rest]
            places: dict[str, int] = {}
            order = np.fromiter((places.setdefault(w, len(places)) for ws in made for w in ws), np.int64)
            flat, sizes = self._solve(list(places))
            starts = np.cumsum(sizes) - sizes
            lengths = sizes[order]
            ends = np.cumsum(lengths)
            whole = flat[np.repeat(starts[order] - (ends - lengths), lengths) + np.arange(len(lengths) and ends[-1])]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(ws) for ws in made])])]
            self._keep(rest, whole, np.diff(bounds))

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.utf8_split_whitespace(texts)
        bounds = parts.offsets.to_numpy()
        coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        unique = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [c for c in unique if c not in self.known]:
            self._learn(new)
        place = np.fromiter(map(self.known.__getitem__, unique), np.int32, len(unique))[coded.indices.to_numpy()] if unique else np.zeros(0, np.int32)
        bounds = bounds - bounds[0]
        del parts, coded, unique
        lengths = self.lengths[place]
        ends = np.cumsum(lengths)
        # where each id stands in the pool; the pool has fewer than 2^31 ids, and the text's own count fits likewise
        shift = (self.starts[place] - (ends - lengths)).astype(np.int32)
        del place
        at = np.repeat(shift, lengths)
        at += np.arange(len(at), dtype=np.int32)
        return self.pool[at], np.concatenate([[0], ends])[bounds]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the place where each text's ids begin (with the end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([^\s\pL\pN]+)", r"\1 \2")
        odd = pc.match_substring_regex(texts, self.odd_row)
        if not pc.any(odd).as_py():
            return self._encode_plain(pc.if_else(pc.match_substring_regex(texts, BEYOND_PLAIN), texts, plain))
        # texts with special tokens or rare separators: cut by hand, then the same path
        pieces, owner = [], []
        for i, (text, strange) in enumerate(zip(texts.to_pylist(), odd.to_pylist(), strict=True)):
            for p in self.mark_split.split(text) if strange and self.mark_split else [text]:
                pieces.append(p)
                owner.append(i)
        ids: list[np.ndarray] = []
        for p in pieces:
            if p in self.special:
                ids.append(np.array([self.special[p]], np.uint32))
            elif any(c in p for c in "\x1c\x1d\x1e\x1f"):
                chunks = [c for c in "".join(" " if self._is_space(c) else c for c in p).split(" ") if c]
                if new := [c for c in dict.fromkeys(chunks) if c not in self.known]:
                    self._learn(new)
                at = [self.known[c] for c in chunks]
                ids.append(np.concatenate([np.zeros(0, np.uint32), *(self.pool[self.starts[k] : self.starts[k] + self.lengths[k]] for k in at)]))
            else:
                ids.append(self._encode_plain(pa.array([p], pa.large_string()))[0])
        count = np.bincount(owner, weights=[len(x) for x in ids], minlength=len(texts)).astype(np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(count)])

    @staticmethod
    def _is_space(c: str) -> bool:
        return c in "\t\n\x0b\x0c\r \x85" or unicodedata.category(c) in ("Zs", "Zl", "Zp")

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Each text's tokens, joined as the library joins them where a vocabulary has no decoder."""
        words = self.token_array.take(pa.array(flat))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words), " ")


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One for each worker process, kept between tasks."""
    return Codec(path)


def encoded(batches, path: str):
    """For batches of (key, text): keys, ids, bounds of bounded slices."""
    tool = codec(path)
    for batch in given_back(batches):
        keys, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for i, j in spans(sizes.tolist(), BATCH_BYTES):
            yield keys.slice(i, j - i), *tool.encode(texts.slice(i, j - i))
        del batch, keys, texts
        pa.default_memory_pool().release_unused()  # workers live on between tasks


def encode_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: number of tokens, SHA-256 of its ids and of the text decoded from them."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def work(batches):
        tool = codec(path)
        for keys, flat, bounds in encoded(batches, path):
            raw, wide = memoryview(flat.astype("<u4").tobytes()), 4 * bounds
            texts = tool.decode(flat, bounds)
            marks = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
            data = memoryview(texts.buffers()[2] or b"")
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(wide[:-1], wide[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(marks[:-1], marks[1:], strict=True)], pa.string()),
                ],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text).mapInArrow(work, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def encode_ids(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document with its ids as an array."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def work(batches):
        for keys, flat, bounds in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32)))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
