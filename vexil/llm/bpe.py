"""BPE encoding and decoding by a tokenization automaton.

compile_ranks builds a deterministic automaton whose arcs are labelled with tokens and that accepts exactly the token
sequences which the merges produce. It starts as one state with an arc for each byte. Each merge (u, v), in order, adds
a gadget: let t be the state that arcs u lead to and r the one that v leads to from t. Every state with an arc u gets an
arc uv to r, and arcs u now lead to a copy of t without the arc v. Written out that is up to vocabulary times vocabulary
arcs, so states are kept as what the gadgets did to them: the arcs cut, each with its time, and for the state behind uv
the state it shares up to that time (the one behind v). Whether an arc leaves a state then follows from the cuts along
its label's left spine.

Encoding is driven by a table over bytes: the automaton with its labels spelled out, made deterministic by subsets. A
state of the table is the set of arcs (state they leave, node of the prefix tree of labels) that the bytes read so far may
be within; as just one accepted sequence spells a word, exactly one arc ends at each byte, and the table's state names
its label. A pre-split word takes one transition for each byte, without going back; its tokens are then read off from its
end, each label's length giving the place of the one before. Transitions are made when they are first taken. Decoding
emits labels.

The vocabulary is a rank file (a base64 token and its rank on each line); its path is a parameter, it is read on the
driver only. Defined results: a null text gives null, an empty one no tokens; special tokens in a text are ordinary
text; other columns pass through, input columns named like the outputs are replaced. Words and texts of any length are
encoded whole, in time and memory in proportion to their length. A text has one encoding only, so there are no ties, and
repeated rows get equal tokens; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vexil.llm.common import string_buffers, sub_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPACE = "\t-\r \x85\xa0  -     　"
START = -1


def _pattern(letters: str, numbers: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _ranges(kind: str, end: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(end) if unicodedata.category(chr(c))[0] == kind)


#: Texts without characters from here on are split by a plain pattern of explicit classes, which is several times faster.
PLAIN = 0x250
_plain = re.compile(_pattern(_ranges("L", PLAIN), _ranges("N", PLAIN)))
_beyond = re.compile(f"[^\\x00-{chr(PLAIN - 1)}]")
_general = regex.compile(_pattern(r"\p{L}", r"\p{N}"))


def split_words(text: str) -> list[str]:
    """The words of a text; joined they are the text again."""
    return (_general if _beyond.search(text) else _plain).findall(text)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(u, v, uv) of each token longer than a byte, in order of rank: what it consists of once all lower merges are done."""
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best[0] >= rank:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], rank))
    return merges


class ByteTable(dict):
    """Transitions of the deterministic automaton over bytes: state << 8 | byte to the next state << 8, made when first asked for. ending has the token of the arc that ends in each state."""

    def __init__(self, automaton: Automaton):
        self.children, self.leaves = automaton.children, automaton.leaves
        first = ((START, 0),)
        self.within, self.ending, self.numbers = [first], [START], {first: 0}

    def __missing__(self, key: int) -> int:
        children, byte = self.children, key & 255
        within, ending = [], START
        for source, node in self.within[key >> 8]:  # the longest first
            child = children.get(node << 8 | byte)
            if child is not None:
                node, token = child
                within.append((source, node))
                if ending == START and token >= 0 and (source == START or self.leaves(source, token)):
                    ending = token
        if ending == START:
            raise ValueError("the vocabulary lacks a byte of the text")
        within.append((ending, 0))
        held = tuple(within)
        state = self.numbers.get(held)
        if state is None:
            state = self.numbers[held] = len(self.within) << 8
            self.within.append(held)
            self.ending.append(ending)
        self[key] = state
        return state


class Automaton:
    """States are named by the token that leads to them, START by none."""

    #: Beyond so many, transitions are made anew; words are remembered in two generations of at most so many.
    MOST_TRANSITIONS, MOST_WORDS, LONGEST_KEPT = 400_000, 150_000, 64

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.labels = {i: t for t, i in ranks.items()}
        self.spine: dict[int, tuple[int, int]] = {}  # of a merged label: its left part and the time it was made
        self.cuts: dict[tuple[int, int], int] = {}
        self.shares: dict[int, tuple[int, int]] = {}
        self.made = {i for t, i in ranks.items() if len(t) == 1}
        for time, (u, v, uv) in enumerate(merges):
            self._gadget(u, v, uv, time)
        self._tables()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("labels", "spine", "cuts", "shares", "made")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._tables()

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        if u not in self.made or v not in self.made or not self.leaves(u, v):
            return  # no path u, v is left: the merge can't happen
        self.cuts[u, v] = time
        self.shares[uv] = (v, time)
        self.spine[uv] = (u, time)
        self.made.add(uv)

    def leaves(self, state: int, label: int) -> bool:
        """Whether the arc leaves the state. Back in time, the state is the one it was shared with and the label its left part; at no time may the arc of the day have been cut before it took part in the label or the state was shared."""
        cuts, shares, spine = self.cuts, self.shares, self.spine
        shared = until = 1 << 60
        while True:
            time = cuts.get((state, label))
            if time is not None and time < shared and time <= until:
                return False
            a, b = shares.get(state), spine.get(label)
            if a is not None and (b is None or a[1] >= b[1]):
                state, shared = a
            elif b is not None:
                label, until = b
            else:
                return True

    def _tables(self) -> None:
        self.sizes = {i: len(self.labels[i]) for i in self.made}
        nodes: dict[int, int] = {}  # node << 8 | byte to node
        token_at = [-1]
        for i in self.made:
            node = 0
            for byte in self.labels[i]:
                key = node << 8 | byte
                node = nodes.get(key, -1)
                if node < 0:
                    node = nodes[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = i
        #: node << 8 | byte to (node, the token that ends there or -1).
        self.children = {key: (node, token_at[node]) for key, node in nodes.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.table = ByteTable(self)

    def encode_word(self, word: bytes) -> list[int]:
        table = self.table
        if len(table) > self.MOST_TRANSITIONS:
            table = self.table = ByteTable(self)
        state, states = 0, []
        for byte in word:
            state = table[state | byte]
            states.append(state)
        ending, sizes, at, path = table.ending, self.sizes, len(word), []
        while at:
            token = ending[states[at - 1] >> 8]
            path.append(token)
            at -= sizes[token]
        path.reverse()
        return path

    def _unseen(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = array("i", self.encode_word(word.encode())).tobytes()
        if len(word) <= self.LONGEST_KEPT:
            if len(self.words) >= self.MOST_WORDS:
                self.older = self.words.copy()
                self.words.clear()
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        known, unseen = self.words.get, self._unseen
        return np.frombuffer(b"".join([known(w) or unseen(w) for w in split_words(text)]), dtype=np.int32)

    def decode(self, ids) -> str:
        labels = self.labels
        return b"".join([labels[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode()


def compile_ranks(path: str = VOCABULARY) -> Automaton:
    ranks = read_ranks(path)
    return Automaton(ranks, merges_of(ranks))


def encode(docs: DataFrame, path: str = VOCABULARY, verify: bool = True) -> DataFrame:
    """docs without their text, with token_ids, n_tokens and, if asked for, whether decoding gives the very text again."""
    automaton = docs.sparkSession.sparkContext.broadcast(compile_ranks(path))
    new = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), *[T.StructField("round_trip", T.BooleanType())] * verify]
    kept = [f for f in docs.schema.fields if f.name not in {"text", *[x.name for x in new]}]
    names = [f.name for f in [*kept, *new]]

    def run(batches):
        a = automaton.value
        for batch in batches:
            _, offsets = string_buffers(batch.column("text"))
            for start, stop in sub_batches(offsets):
                part = batch.slice(start, stop - start)
                texts = part.column("text").to_pylist()
                ids = [None if t is None else a.encode(t) for t in texts]
                none = np.array([i is None for i in ids] + [False])
                real = [i for i in ids if i is not None]
                lengths = np.array([0 if i is None else len(i) for i in ids], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=none), pa.array(np.concatenate(real) if real else np.zeros(0, np.int32)))
                columns = [*[part.column(f.name) for f in kept], lists, pa.array(lengths, mask=none[:-1])]
                if verify:
                    columns.append(pa.array([None if t is None else a.decode(i) == t for t, i in zip(texts, ids)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType([*kept, *new]))


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The inverse: token_ids as text, other columns passed through; null stays null."""
    automaton = tokens.sparkSession.sparkContext.broadcast(compile_ranks(path))
    kept = [f for f in tokens.schema.fields if f.name not in ("token_ids", "text")]
    names = [*[f.name for f in kept], "text"]

    def run(batches):
        a = automaton.value
        for batch in batches:
            texts = [None if i is None else a.decode(i) for i in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], names)

    return tokens.mapInArrow(run, T.StructType([*kept, T.StructField("text", T.StringType())]))
