"""Operator 3: token counts by a finite-state transducer compiled from a byte-pair vocabulary.

A token sequence is the vocabulary's encoding of a word exactly if every token encodes itself and every adjacent pair of
tokens encodes itself: a property of pairs, so a nondeterministic machine over bytes can follow (last token, beginning of
the next). Determinised with the counts kept as residuals, it becomes a transducer: its state says which beginnings are
open and after which token, and each transition carries the change in the number of tokens, so that the sum of a word's
transitions is its token count. States are compiled when text first needs them; beginnings that no compatible token
continues are dropped and last tokens that allow the same continuations are merged, which keeps the machine small.
When it outgrows MAX_CELLS it is thrown away and compiled anew from the next slice on; counts don't depend on that.

Text becomes a stream of bytes with an end mark after each word, cut into chunks that numpy runs side by side. A chunk
that has a word end maps every incoming state to one outgoing state. A chunk inside a long word has a map that is known
for some incoming states: it is run from the start state and from those that the chunk before may leave, all such chunks
side by side, and equal chunks share one map. The maps are composed in a parallel prefix scan, by pointer doubling, which
gives every chunk its true incoming state; where a map lacks a state that the scan reaches, it is run for it and the scan
repeated. Machines of this kind forget their start soon, so two or three repeats do; after ROUNDS of them what is left of
a word is followed symbol by symbol. With the true states, heads of chunks (up to the first word end) and inner chunks are
run again side by side for their counts.

Defined cases: a very long text is worked on in slices, a very long word in one; null text has 0 bytes and 0 tokens; white space has no tokens; strings of special tokens count as one
token each, as is the library's default; repeated rows are counted one by one; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm.common import bounded_batches, pick, read_table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Code points that are worked on at a time, and symbols in a chunk.
SLICE = 1 << 20
CHUNK = 512
#: Transitions in memory at most (4 bytes each).
MAX_CELLS = 24_000_000
#: Continuations up to which last tokens are merged by what they allow.
MERGE_UPTO = 64
END = 256
#: Repeats of the prefix scan before a long word is followed symbol by symbol, and those that run chunks on suspicion.
ROUNDS, SUSPECTED = 24, 2
SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255


class Machine:
    """The transducer of a word vocabulary. Symbols are bytes, then END."""

    def __init__(self, model: dict):
        char = _byte_chars()
        of_char = {c: b for b, c in enumerate(char)}
        suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(merges)}
        self.parts = {}
        for k, (a, b) in enumerate(merges):
            self.parts.setdefault(a + b, (a, b, k))
        names = [t for t in model["vocab"] if t in self.parts or t in of_char or (t.endswith(suffix) and t.removesuffix(suffix) in of_char)]
        self.right, self.left = {}, {}  # spines of (piece, rank at which it is merged into the next), from the edge inwards
        self.child: list[dict[int, int]] = [{}]
        self.token: list[str | None] = [None]
        for t in names:
            if not self._encodes_itself(t, suffix):
                continue
            ended = t.endswith(suffix)
            symbols = [of_char[c] for c in (t.removesuffix(suffix) if ended else t)] + [END] * ended
            node = 0
            for s in symbols:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(None)
                node = self.child[node][s]
            self.token[node] = t
        self.size = [0] * len(self.child)  # tokens strictly below a node
        for node in range(len(self.child) - 1, -1, -1):
            self.size[node] = sum(self.size[c] + (self.token[c] is not None) for c in self.child[node].values())
        self.reset()

    def _encodes_itself(self, t: str, suffix: str) -> bool:
        """Whether merging the token's own symbols by rank yields just the token."""
        ended = t.endswith(suffix)
        s = list(t.removesuffix(suffix) if ended else t)
        if ended:
            s[-1] += suffix
        while len(s) > 1:
            k, i = min((self.rank.get((s[i], s[i + 1]), 1 << 60), i) for i in range(len(s) - 1))
            if k == 1 << 60:
                return False
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s[0] == t

    def _spine(self, t: str, side: int) -> list[tuple[str, int]]:
        """The pieces that stand at one edge of the token while it is merged, smallest first, and when each goes."""
        known = self.left if side == 0 else self.right
        if t not in known:
            spine, piece, gone = [], t, 1 << 60
            while True:
                spine.append((piece, gone))
                if piece not in self.parts:
                    break
                gone = self.parts[piece][2]
                piece = self.parts[piece][side]
            known[t] = spine[::-1]
        return known[t]

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019  one machine lives as long as its worker; asked again mostly at once
    def compatible(self, a: str, b: str) -> bool:
        """Whether a then b is the encoding of both together: no merge ever joins their edges."""
        right, left, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            (x, x_gone), (y, y_gone) = right[i], left[j]
            m = self.rank.get((x, y))
            # the leftmost of equal merges goes first: the one inside a before, the one inside b after this one
            if m is not None and m < x_gone and m <= y_gone:
                return False
            if x_gone == y_gone == 1 << 60:
                return True
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1
            if i == len(right) or j == len(left):
                return True

    def _below(self, node: int) -> list[str]:
        if node not in self.under:
            out, work = [], list(self.child[node].values())
            while work:
                n = work.pop()
                if self.token[n] is not None:
                    out.append(self.token[n])
                work.extend(self.child[n].values())
            self.under[node] = out
        return self.under[node]

    def _open(self, node: int, last: str | None) -> str | None | bool:
        """A last token that allows the same continuations below node, or False if there are none."""
        if not self.size[node]:
            return False
        if last is None or self.size[node] > MERGE_UPTO:
            return last
        key = (node, last)
        if key not in self.alike:
            allowed = frozenset(t for t in self._below(node) if self.compatible(last, t))
            self.alike[key] = self.first.setdefault((node, allowed), last) if allowed else False
        return self.alike[key]

    def reset(self) -> None:
        self.under, self.alike, self.first = {}, {}, {}
        self.column = np.full(257, -1, np.int64)
        self.columns: list[int] = []
        self.states = [((0, None, 0),)]
        self.index = {self.states[0]: 0}
        self.table = np.full((1024, 64), -1, np.int32)
        self.use([END])

    def use(self, symbols: list[int]) -> None:
        """Give each symbol a column of the table."""
        for s in symbols:
            self.column[s] = len(self.columns)
            self.columns.append(s)
        if len(self.columns) > self.table.shape[1]:
            wide = np.full((self.table.shape[0], min(257, max(2 * self.table.shape[1], len(self.columns)))), -1, np.int32)
            wide[:, : self.table.shape[1]] = self.table
            self.table = wide

    def compile(self, state: int, column: int) -> None:
        """Enter the transition: next state * 256 + change in the number of tokens + 128."""
        symbol, found, whole = self.columns[column], set(), None
        if symbol == END and state == 0:  # a chunk may begin with a word end, whose change its head's second run gives
            self.table[state, column] = 128
            return
        for node, last, count in self.states[state]:
            n = self.child[node].get(symbol)
            if n is None:
                continue
            t = self.token[n]
            if t is not None and (last is None or self.compatible(last, t)):
                assert whole is None or whole == (t, count + 1), "two encodings of one text"
                whole = (t, count + 1)
            if symbol != END and (keep := self._open(n, last)) is not False:
                found.add((n, keep, count))
        assert whole is not None, "a byte without a token"
        change = whole[1]
        if symbol == END:
            to = 0
        else:
            key = tuple(sorted([(0, whole[0], 0), *((n, last, c - change) for n, last, c in found)], key=lambda x: (x[0], x[1] or "", x[2])))
            to = self.index.get(key)
            if to is None:
                to = self.index[key] = len(self.states)
                self.states.append(key)
                if to == len(self.table):
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        self.table[state, column] = to * 256 + change + 128

    def step(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        got = self.table[states, columns]
        if got.min(initial=0) < 0:
            for s, c in sorted({(s, c) for s, c in zip(states[got < 0].tolist(), columns[got < 0].tolist())}):
                self.compile(s, c)
            got = self.table[states, columns]
        return got

    def through(self, columns: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The states that chunks, one a column, leave when they are entered in the given states."""
        for row in columns:
            states = self.step(states, row) >> 8
        return states

    def incoming(self, columns: np.ndarray, inner: np.ndarray, leaving: np.ndarray) -> np.ndarray:
        """The true incoming state of each chunk without a word end, by composing state maps.

        `leaving` has the states that all chunks leave when they are entered in the start state, which are the true ones
        for chunks with a word end.
        """
        text, same = np.unique(columns[:, inner], axis=1, return_inverse=True)
        same = same.reshape(-1)
        begins = np.concatenate([[True], np.diff(inner) > 1])  # the first chunk of each long word
        true = np.where(inner > 0, leaving[inner - 1], 0)[begins]
        known: list[dict[int, int]] = [{} for _ in range(text.shape[1])]  # by content: incoming state -> state it leaves

        def learn(pairs: set[tuple[int, int]]) -> None:
            new = np.array(sorted(p for p in pairs if p[1] not in known[p[0]]), np.int64).reshape(-1, 2)
            if len(new):
                for (c, s), to in zip(new.tolist(), self.through(text[:, new[:, 0]], new[:, 1]).tolist()):
                    known[c][s] = to

        for c, to in zip(same.tolist(), leaving[inner].tolist()):
            known[c][0] = to
        entries: list[list[int]] = [[0] for _ in inner]  # the incoming states that each chunk's map is taken for
        for i, s in zip(np.nonzero(begins)[0].tolist(), true.tolist()):
            entries[i] = [s]
        state, found = np.full(len(inner), -1, np.int64), begins.copy()
        state[begins] = true
        goes_on = np.append(~begins[1:], False)  # whether the next chunk is of the same word
        for n in range(ROUNDS):
            learn({(c, s) for c, own in zip(same.tolist(), entries) for s in own})
            # a node for each chunk and incoming state; its pointer is the one that the next chunk is entered with
            size = np.array([len(own) for own in entries])
            base = np.cumsum(size) - size
            enters, lane = np.array([s for own in entries for s in own]), np.repeat(np.arange(len(inner)), size)
            stop = len(enters)  # no further node
            jump, lacking = np.full(stop + 1, stop), []
            for node, (i, s) in enumerate(zip(lane.tolist(), enters.tolist())):
                if goes_on[i]:
                    to = known[same[i]][s]
                    if to in entries[i + 1]:
                        jump[node] = base[i + 1] + entries[i + 1].index(to)
                    else:
                        lacking.append((node, i + 1, to))
            reached = np.zeros(stop + 1, bool)
            reached[base[begins]] = True
            for _ in range(len(inner).bit_length()):  # doubling: the maps of 1, 2, 4, ... chunks together
                reached[jump[reached]] = True
                jump = jump[jump]
            at = np.nonzero(reached[:stop])[0]
            state[lane[at]], found[lane[at]] = enters[at], True
            if found.all():
                return state
            for node, i, to in lacking:
                if n < SUSPECTED or reached[node]:
                    while to not in entries[i]:
                        entries[i].append(to)
                        if not (reached[node] and goes_on[i] and to in known[same[i]]):
                            break
                        i, to = i + 1, known[same[i]][to]  # an equal chunk's map is known for it
        for i in np.nonzero(~found)[0].tolist():  # in order, each after the chunk before
            s = int(state[i - 1])
            for c in columns[:, inner[i - 1]].tolist():
                v = int(self.table[s, c])
                if v < 0:
                    self.compile(s, c)
                    v = int(self.table[s, c])
                s = v >> 8
            state[i], found[i] = s, True
        return state

    def run(self, stream: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The change in the number of tokens at each place of a stream that ends with END."""
        if self.table.size > MAX_CELLS:
            self.reset()
        if len(new := np.unique(stream)[self.column[np.unique(stream)] < 0]):
            self.use(new.tolist())
        end = int(self.column[END])
        lanes = -(-len(stream) // chunk)
        padded = np.full(lanes * chunk, end, np.int32)  # the first pad is never read as a word end of text
        padded[: len(stream)] = self.column[stream]
        by_lane = padded.reshape(lanes, chunk)
        columns = np.ascontiguousarray(by_lane.T)
        out = np.zeros((chunk, lanes), np.int8)
        last = len(stream) - (lanes - 1) * chunk
        # every chunk from the start state: right from its first word end on
        state = np.zeros(lanes, np.int64)
        for k in range(chunk):
            if k == last and lanes > 1:
                tail, state = state[-1], state[:-1]
            elif k == last:
                break
            n = len(state)
            got = self.step(state, columns[k, :n])
            out[k, :n] = (got & 255) - 128
            state = got >> 8
        ends = by_lane == end
        has = ends.any(1)
        head = np.where(has, ends.argmax(1), chunk - 1)
        leaving = np.zeros(lanes, np.int64)
        leaving[: len(state)] = state
        # chunks inside one word again, side by side, from the states that the prefix scan gives
        inner = np.nonzero(~has)[0]
        if len(inner):
            state = self.incoming(columns, inner, leaving)
            for k in range(chunk):
                got = self.step(state, columns[k, inner])
                out[k, inner] = (got & 255) - 128
                state = got >> 8
            leaving[inner] = state
        # heads again, side by side, from the states that the chunks before leave
        lane = np.nonzero(has)[0]
        lane = lane[lane > 0]
        state, k = leaving[lane - 1], 0
        going = state != 0  # from the start state they were right at once
        lane, state = lane[going], state[going]
        while len(lane):
            got = self.step(state, columns[k, lane])
            out[k, lane] = (got & 255) - 128
            more = head[lane] > k
            lane, state, k = lane[more], (got >> 8)[more], k + 1
        return out.T.reshape(-1)[: len(stream)]


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    """Counts tokens as the library does for a vocabulary file: normaliser, word rules, then the machine."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.normalizers import NFC

        self.library, self.nfc = Tokenizer.from_file(path), NFC()
        with open(path, encoding="utf-8") as f:
            self.machine = Machine(json.load(f)["model"])
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.int32)
        self.long: dict[str, str] = {}

    def learn(self, codes: np.ndarray) -> None:
        """Case and class of characters, asked of the library itself."""
        pieces = self.library.pre_tokenizer.pre_tokenize_str
        for code in codes.tolist():
            c = chr(code)
            low = c if code == 10 else self.library.normalizer.normalize_str(c)
            if len(low) > 1:
                self.long[c] = low
                continue
            self.lower[code] = ord(low)
            if low.isspace() or not pieces(low):
                self.kind[code] = SPACE if not pieces(low) else OTHER
            elif len(pieces("a" + low)) == 1:
                self.kind[code] = LETTER
            elif len(pieces("!" + low)) == 1:
                self.kind[code] = OTHER
            else:
                self.kind[code] = NUMBER

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        held, owner, n = [], [], 0
        for i, text in enumerate(texts):
            if "<|" in text:
                text, specials = self.special.subn("\n", text)
                out[i] += specials
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = self.nfc.normalize_str(text)
            for piece in _slices(text):
                held.append(piece)
                owner.append(i)
                n += len(piece)
                if n >= SLICE:
                    self._add(held, owner, out)
                    held, owner, n = [], [], 0
        if held:
            self._add(held, owner, out)
        return out

    def _add(self, texts: list[str], owner: list[int], out: list[int]) -> None:
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        if (kind == UNKNOWN).any():
            self.learn(np.unique(code[kind == UNKNOWN]))
            kind = self.kind[code]
            if (kind == UNKNOWN).any():  # characters whose lower case is longer
                table = str.maketrans(self.long)
                return self._add([t.translate(table) for t in texts], owner, out)
        starts_of = np.cumsum([0, *(len(t) + 1 for t in texts)])
        code = self.lower[code]
        before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        quote = np.nonzero((code == 39) & start)[0]
        if len(quote):
            a = code[np.minimum(quote + 1, len(code) - 1)]
            b = code[np.minimum(quote + 2, len(code) - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            start[quote[one | two] + 1] = False
            for at in (quote[one] + 2, quote[two] + 3):
                start[at] = kind[at] != SPACE
        word = kind != SPACE
        raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        if len(raw) == len(code):
            keep, first = word, start
            byte_at = starts_of
        else:
            width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            at = np.cumsum(width) - width
            keep, first = np.repeat(word, width), np.zeros(len(raw), bool)
            first[at[start]] = True
            byte_at = np.concatenate([at, [len(raw)]])[starts_of]
        kept = np.concatenate([[0], np.cumsum(keep)])
        words = np.concatenate([[0], np.cumsum(first)])
        if not words[-1]:
            return None
        stream = np.full(kept[-1] + words[-1], END, np.int64)
        stream[(kept[:-1] + words[1:] - 1)[keep]] = raw[keep]
        upto = np.concatenate([[0], np.cumsum(self.machine.run(stream), dtype=np.int64)])
        total = np.diff(upto[kept[byte_at] + words[byte_at]])
        for i, t in zip(owner, total.tolist()):
            out[i] += t
        return None


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about SLICE characters, cut where white space precedes an ASCII letter."""
    at = 0
    while len(text) - at > 2 * SLICE and (m := re.compile(r"[ \n\t](?=[A-Za-z])").search(text, at + SLICE)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


@functools.lru_cache(maxsize=2)
def counter(name: str = VOCABULARY) -> Counter:
    import public_tokenizers

    return Counter(public_tokenizers.path(name))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw = [r or b"" for r in part.column(1).cast(pa.binary()).to_pylist()]
                n = own.counts([r.decode() for r in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return pick(docs, "doc_id", "text").mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
