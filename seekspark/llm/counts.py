"""Token counts that follow edits.

A document is a tree over its pre-tokens, the pieces that the tokenizer's pattern divides it into and encodes one by one.
Leaves hold some tens of pieces with their token counts, inner nodes the sums of characters, pieces and tokens below them.
An edit finds its place by the sums of characters and starts at the last boundary that the edit cannot move: the pattern
looks at most one character beyond a piece's end. From there it divides anew until a boundary behind the edit meets an old
one; the pattern never looks back, so everything beyond is as it was. Only those pieces are encoded, and only the sums above
them change.

`count_edits` builds the trees, or takes them over from `trees`, applies each row's edits in turn and returns the counts.
Edits are an array of (start, length, replacement), in code points of the text as the edits before have left it; what
reaches beyond the text is clipped, a null replacement is empty, a null edit does nothing. Null text is empty. Repeated
rows are counted each on its own, extra columns are not read, empty tables give empty results; texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.llm.common import batch_of, slices, small_batches, whole_text
from seekspark.llm.tokens import byte_letters

LEAF, FAN = 32, 16
#: Pieces whose counts are remembered, per Python worker. It bounds memory and changes no result.
REMEMBERED = 400_000
FIRST_READ = 256


class PieceCounter(dict):
    """piece -> number of tokens, for byte-level vocabularies in the library's own format."""

    def __init__(self, definition: str, pattern: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition).model
        self.divide = regex.compile(pattern).findall
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize("".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.clear()


class _Node:
    """A leaf has pieces and counts, an inner node kids."""

    __slots__ = ("kids", "pieces", "counts", "chars", "size", "tokens")

    def __init__(self, kids: list | None, pieces: list[str] | None = None, counts: list[int] | None = None) -> None:
        self.kids, self.pieces, self.counts = kids, pieces, counts
        self.sum()

    def sum(self) -> None:
        if self.kids is None:
            self.chars, self.size, self.tokens = sum(map(len, self.pieces)), len(self.pieces), sum(self.counts)
        else:
            self.chars = sum(k.chars for k in self.kids)
            self.size = sum(k.size for k in self.kids)
            self.tokens = sum(k.tokens for k in self.kids)


def _leaves(pieces: list[str], counts: list[int]) -> list[_Node]:
    return [_Node(None, pieces[i:i + LEAF], counts[i:i + LEAF]) for i in range(0, len(pieces), LEAF)]


def _root(nodes: list[_Node]) -> _Node:
    while len(nodes) > 1:
        nodes = [_Node(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]
    return nodes[0] if nodes else _Node(None, [], [])


def _spliced(node: _Node, low: int, high: int, pieces: list[str], counts: list[int]) -> list[_Node]:
    """The node with its pieces low..high replaced, as one or more nodes of the same height (none if nothing is left)."""
    if node.kids is None:
        node.pieces[low:high], node.counts[low:high] = pieces, counts
        if len(node.pieces) > 2 * LEAF:
            return _leaves(node.pieces, node.counts)
        node.sum()
        return [node] if node.pieces else []
    kids, at, placed = [], 0, False
    for kid in node.kids:
        first, last = at, at + kid.size
        at = last
        takes = not placed and low <= last  # the new pieces go into the first kid that the range touches
        if takes or (first < high and low < last):
            new = (pieces, counts) if takes else ([], [])
            placed = placed or takes
            kids += _spliced(kid, max(low - first, 0), max(min(high, last) - first, 0), *new)
        else:
            kids.append(kid)
    if len(kids) > 2 * FAN:
        return [_Node(kids[i:i + FAN]) for i in range(0, len(kids), FAN)]
    node.kids = kids
    node.sum()
    return [node] if kids else []


class TokenTree:
    def __init__(self, counter: PieceCounter, pieces: list[str], counts: list[int] | None = None) -> None:
        self.counter = counter
        self.root = _root(_leaves(pieces, [counter[p] for p in pieces] if counts is None else counts))
        self.encoded = 0  # characters encoded by edits

    @property
    def tokens(self) -> int:
        return self.root.tokens

    def find(self, char: int) -> tuple[int, int]:
        """(number, first character) of the piece that holds the character; of the end, if the text is shorter."""
        node, number, at = self.root, 0, 0
        while node.kids is not None:
            for kid in node.kids:
                if char < at + kid.chars or kid is node.kids[-1]:
                    break
                number, at = number + kid.size, at + kid.chars
            node = kid
        for piece in node.pieces:
            if char < at + len(piece):
                break
            number, at = number + 1, at + len(piece)
        return number, at

    def walk(self, number: int) -> Iterator[str]:
        """The pieces from that number on."""
        stack = [(self.root, number)]
        while stack:
            node, skip = stack.pop()
            if node.kids is None:
                yield from node.pieces[skip:]
                continue
            ahead = []
            for kid in node.kids:
                if skip >= kid.size:
                    skip -= kid.size
                else:
                    ahead.append((kid, skip))
                    skip = 0
            stack.extend(reversed(ahead))

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(start, 0), self.root.chars)
        length = min(max(length, 0), self.root.chars - start)
        first, begin = self.find(max(start - 2, 0))  # pieces before this one end two characters before the edit or earlier
        old, old_ends, read, source = [], [], begin, self.walk(first)
        want = start + length + FIRST_READ
        while True:
            for piece in source:
                read += len(piece)
                old.append(piece)
                old_ends.append(read)
                if read >= want:
                    break
            text = "".join(old)
            end = read >= self.root.chars
            new = text[:start - begin] + replacement + text[start + length - begin:]
            pieces = self.counter.divide(new)
            # A boundary counts if the pattern saw the character behind it, and one more, or the end.
            at, shift = begin, len(replacement) - length
            places = {e: i + 1 for i, e in enumerate(old_ends)}
            meet = None
            for i, piece in enumerate(pieces):
                at += len(piece)
                if at + 1 < begin + len(new) and at - shift >= start + length and at - shift in places:
                    meet = i + 1, places[at - shift]
                    break
            if meet is None and end:
                meet = len(pieces), len(old)
            if meet is not None:
                break
            want = read + (read - begin)
        taken = pieces[:meet[0]]
        self.encoded += sum(map(len, taken))
        self.root = _root(_spliced(self.root, first, first + meet[1], taken, [self.counter[p] for p in taken]))


_counters: dict[tuple[int, str], PieceCounter] = {}


def _counter(definition: str, pattern: str) -> PieceCounter:
    key = hash(definition), pattern
    if key not in _counters:
        _counters[key] = PieceCounter(definition, pattern)
    return _counters[key]


def _definition(docs: DataFrame, tokenizer: str | None, pattern: str | None):
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast((file.read(), pattern or public_tokenizers.PATTERN))


def trees(docs: DataFrame, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, lengths, counts: the leaves of every document's tree, to be kept beside the texts."""
    shared = _definition(docs, tokenizer, pattern)
    rows = docs.select("doc_id", whole_text("text").alias("text"))
    schema = rows.select("doc_id", F.lit(None).cast("array<int>").alias("lengths"), F.lit(None).cast("array<int>").alias("counts")).schema

    def run(batches):
        counter = _counter(*shared.value)
        for part in slices(batches, "text"):
            pieces = [counter.divide(t) for t in part.column("text").to_pylist()]
            lengths, counts = [[len(p) for p in x] for x in pieces], [[counter[p] for p in x] for x in pieces]
            counter.age()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(x, pa.list_(pa.int32())) for x in (lengths, counts))], names=["doc_id", "lengths", "counts"])

    return small_batches(rows).mapInArrow(run, schema)


def count_edits(docs: DataFrame, edits: Column, kept: bool = False, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_pieces_edited, encoded_chars for every row.

    edits: array<struct<start: int, length: int, replacement: string>>. kept: the rows also carry `lengths` and `counts` of
    `trees`, and nothing but the edited regions is encoded.
    """
    shared = _definition(docs, tokenizer, pattern)
    state = ["lengths", "counts"] if kept else []
    rows = docs.select("doc_id", whole_text("text").alias("text"), edits.cast("array<struct<start:int,length:int,replacement:string>>").alias("edits"), *state)
    names = ["n_tokens", "n_tokens_edited", "n_chars_edited", "n_pieces_edited", "encoded_chars"]
    schema = rows.select("doc_id", *[F.lit(0).cast("long").alias(n) for n in names]).schema

    def run(batches):
        counter = _counter(*shared.value)
        for part in slices(batches, "text"):
            out = []
            kept_rows = zip(*(part.column(c).to_pylist() for c in state), strict=True) if kept else [None] * part.num_rows
            for text, changes, leaves in zip(part.column("text").to_pylist(), part.column("edits").to_pylist(), kept_rows, strict=True):
                if leaves:
                    ends = [0]
                    for n in leaves[0]:
                        ends.append(ends[-1] + n)
                    tree = TokenTree(counter, [text[a:b] for a, b in zip(ends, ends[1:], strict=False)], list(leaves[1]))
                else:
                    tree = TokenTree(counter, counter.divide(text))
                before = tree.tokens
                for change in changes or ():
                    if change:
                        tree.edit(change["start"] or 0, change["length"] or 0, change["replacement"] or "")
                out.append((before, tree.tokens, tree.root.chars, tree.root.size, tree.encoded))
            counter.age()
            schema = pa.schema([part.schema.field("doc_id"), *[(n, pa.int64()) for n in names]])
            yield batch_of(schema, [part.column("doc_id"), *map(list, zip(*out, strict=True))])

    return small_batches(rows).mapInArrow(run, schema)


def sample_edits() -> Column:
    """Three edits for any document, from its own text: a cut, a repeat of its beginning, a word in another case."""
    text = whole_text("text")
    n = F.length(text)

    def edit(start: Column, length: int, replacement: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(length).alias("length"), replacement.alias("replacement"))

    return F.array(
        edit(F.floor(n / 4), 20, F.lit("")), edit(F.floor(n / 2), 0, F.substring(text, 1, 40)),
        edit(F.floor(n * 3 / 4), 10, F.upper(F.substring(text, 5, 12))))
