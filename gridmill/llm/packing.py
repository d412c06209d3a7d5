"""Best-fit packing of token sequences by bin completion.

Documents are tokenised where they lie; longer ones are cut at the sequence length.  How many pieces
have each length is a table of at most ``capacity`` rows, whatever the corpus, and the search runs on that:

* the incumbent is best-fit decreasing over the table, a whole run of equal lengths at a time;
* if it uses more bins than the bound of Martello and Toth (``least``), branch-and-bound
  looks for fewer: around the largest piece left it tries all undominated fillings in the order of their waste, each
  for as many bins at once as the table allows, and cuts a branch once its waste exceeds what the target leaves.
  Where no waste is left and at most ``FEW`` lengths are, a branch is also cut once some piece has no filling, and
  bins are completed around the piece with the fewest.  Dives in other orders share the budget with the whole search, since a bad
  choice near the root can't be mended below.

One bound, ``NODES`` choices that lead nowhere, ends the search; ``packed`` tells a proved optimum from a bound that was reached.

The answer is a list of patterns with multiplicities.  Pieces get their place by rank among
the pieces of their length; the ranks come from counts per (length, salt), so a very common length is dealt to
many tasks.

Defined cases: null counts as empty text, which is one piece holding the end id alone.  Repeated rows and rows
without id are packed like all others.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import random
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from functools import lru_cache
from itertools import chain, islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import sliced, tidied, written
from ._memo import Memo
from .bpe import byte_alphabet

CAPACITY = 4096
SALTS = 64
PART = 1_000_000  # pieces of one length that a task ranks at most, or so
NODES = 16_000
FEW = 300
FILLINGS = 4
MEMO = 300_000
#: Letters that lower-case one by one and have no other normal form, and the vocabulary's pre-tokens of words made of them.
PLAIN = r"[!-~À-ÖØ-öø-įĲ-ňŊ-ſ]+"
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+"
#: What may end a word as a pre-token of its own, without signs that special tokens are made of.
TAIL = b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


@lru_cache(maxsize=2)
def word_ids(path: str) -> Memo:
    """Ids of a word without ASCII white space, by the tokenizers library; one memo for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    merge, alphabet = tokenizer.model.tokenize, str.maketrans({chr(b): c for c, b in byte_alphabet().items()})

    def unit_ids(unit: bytes) -> bytes:
        ids = [x.id for x in merge(unit.decode("latin-1").translate(alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    units = Memo(unit_ids, MEMO)
    plain, split = re.compile(PLAIN).fullmatch, re.compile(UNITS).findall

    def make(word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters alone are one unit
            return units[word.lower()]
        core = word.rstrip(TAIL)
        if core.isalpha():  # and so is what follows them; other words that end so share the ids of their letters
            return units[core.lower()] + units[word[len(core) :]]
        text = word.decode()
        if plain(text) and "<|" not in text:  # the normaliser only lower-cases these, and the units are the pre-tokens
            return b"".join([units[x.encode()] for x in split(text.lower())])
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    return Memo(make, MEMO)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """_id, _row, piece, start, length, ids_crc32 of every piece; white space never matters to this kind of tokenizer."""

    def run(batches):
        import pyarrow as pa

        memo = word_ids(path)
        end = struct.pack("<I", end_id)
        for batch in sliced(batches, 2048):
            texts = batch.column(2).cast(pa.binary())
            out: tuple = ([], [], [], [], [])
            for k in range(batch.num_rows):
                ids = b"".join([*map(memo.__getitem__, (texts[k].as_py() or b"").split()), end])
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, x in zip(out, (k, number, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
            which = pa.array(out[0], pa.int64())
            columns = [batch.column(0).take(which), batch.column(1).take(which), *(pa.array(x, t) for x, t in zip(out[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", "_row", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.monotonically_increasing_id(), F.col(text_col).cast("string"))
    return rows.mapInArrow(tidied(run), f"_id {kind}, _row long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, all bins with the same content at once."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # free space that some bin has, ascending
    full: list[tuple[Pattern, int]] = []

    def add(room: int, pattern: Pattern, times: int) -> None:
        if not room:
            full.append((pattern, times))
            return
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, pattern, times = capacity, (), left
            each = min(room // length, left)
            bins = min(times, left // each)
            if bins < times and pattern:
                add(room, pattern, times - bins)
            add(room - each * length, (*pattern, (length, each)), bins)
            left -= each * bins
    return full + [x for group in open_.values() for x in group]


class _Table:
    """How many pieces of each length are left, and which lengths, as bits and as bits from the capacity down."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity, self.bits, self.flip = {n: c for n, c in counts.items() if c}, capacity, 0, 0
        for n in self.counts:
            self.bits |= 1 << n
            self.flip |= 1 << capacity - n

    def take(self, pattern: Pattern, times: int) -> None:
        """Remove ``times`` such bins; give them back if it is negative."""
        for n, k in pattern:
            before = self.counts.get(n, 0)
            after = before - k * times
            if after:
                self.counts[n] = after
            else:
                del self.counts[n]
            if not before or not after:
                self.bits ^= 1 << n
                self.flip ^= 1 << self.capacity - n

    def few(self, total: int, k: int, least: int, among: int):
        """Ascending tuples of ``k`` pieces of ``least`` or more, with lengths whose bits are in ``among``, that add up to ``total``, most even first."""
        if k == 1:
            if total >= least and among >> total & 1:
                yield (total,)
            return
        near = total // k
        if k == 2:  # a bit is left where both a length and what it leaves exist
            found = among & self.flip >> self.capacity - total & (1 << near + 1) - 1
        else:
            least = max(least, total - (k - 1) * (self.bits.bit_length() - 1))
            found = among & (1 << near + 1) - 1
        found >>= least
        while found:
            n = found.bit_length() - 1
            found ^= 1 << n
            n += least
            if k == 2:
                if among >> total - n & 1 and (2 * n != total or self.counts[n] > 1):
                    yield (n, total - n)
                continue
            for rest in self.few(total - n, k - 1, n, among):
                if rest[0] != n or rest.count(n) < self.counts[n]:
                    yield (n, *rest)

    def many(self, total: int, least: int, among: int):
        """The ascending tuples of four or more pieces that add up to ``total``, with lengths of ``least`` or more whose bits are in ``among``."""
        counts, whole, bits, order = self.counts, (1 << total + 1) - 1, among & (1 << max(0, total - 3 * least + 1)) - 1, []
        reach = [1]  # bit s of reach[k]: the pieces from place k on can add up to s
        while bits:
            n = bits.bit_length() - 1
            bits ^= 1 << n
            order.append(n)
            sums, left, times = reach[-1], min(counts[n], total // n), 1
            while left:
                step = min(times, left)
                sums |= sums << n * step & whole
                left, times = left - step, 2 * times
            reach.append(sums)
        order.reverse()
        reach.reverse()
        # Levels of [first place, place, copies of that piece still to try, what is left to fill, chosen so far]: largest piece and most
        # copies first.  A level makes its next choice only when it is asked for.
        stack: list[list] = []

        def down(at: int, left: int, chosen: tuple[int, ...]) -> None:
            last = bisect_left(range(at, len(order)), True, key=lambda k: order[k] > left or not reach[k] >> left & 1)  # reach only shrinks
            stack.append([at, at + last, 0, left, chosen])

        down(0, total, ())
        while stack:
            level = stack[-1]
            at, k, copies, left, chosen = level
            if not copies:
                if k == at:
                    stack.pop()
                    continue
                k -= 1
                copies = min(counts[order[k]], left // order[k])
            rest = left - copies * order[k]
            level[1:3] = k, copies - 1
            if not reach[k + 1] >> rest & 1:
                continue
            got = chosen + (order[k],) * copies
            if rest:
                down(k + 1, rest, got)
            elif len(got) > 3:
                yield got

    def dominated(self, waste: int, way: tuple[int, ...]) -> bool:
        """Does a piece outside ``way`` fit into the waste, or in place of a shorter one and some of the waste?"""
        free, window = self.bits, (1 << waste) - 1
        for n in set(way):
            if self.counts[n] == way.count(n):
                free ^= 1 << n
        return any(free >> n + 1 & window for n in (0, *way))

    def fillings(self, room: int, spare: int, most: int | None = None):
        """(waste, tuple of lengths) for the undominated ways to fill ``room``, of at most ``most`` pieces and a waste of at most ``spare``.

        Least waste first, then one, two, three and more pieces; one by one.  A filling is dominated if a piece left outside
        fits too, if one of its pieces could give way to a longer one left outside, or if one piece outside fills the room alone.

        A length with more pieces than the room holds always has one outside, so with waste no piece up to that waste below such a length is
        tried: where lengths are many and common, none is left after the first few wastes.
        """
        counts = self.counts
        if room in counts:
            yield 0, (room,)
            return
        least = (self.bits & -self.bits).bit_length() - 1 if counts else room + 1
        if least > room:
            if room <= spare:
                yield room, ()
            return
        among, common, below = self.bits, None, 0
        for waste in range(min(room - least, spare) + 1):
            total = room - waste
            if waste:
                if common is None:
                    common = sum(1 << n for n, c in counts.items() if n * c > room)
                below |= common >> waste
                among = self.bits & ~below
                if below & 1 or not among & (1 << total + 1) - 1:
                    return
            ways = [self.few(total, k, least, among) for k in range(1, min(3, most or 3) + 1)]
            if 4 * least <= total and not most:
                ways.append(self.many(total, least, among))
            for way in chain.from_iterable(ways):
                if not waste or not self.dominated(waste, way):
                    yield waste, way


def complete(counts: dict[int, int], capacity: int, target: int, nodes: int = NODES, dive: int = 0) -> tuple[list[tuple[Pattern, int]] | None, bool, int]:
    """Bin completion for ``target`` bins: (packing or None, whether None is a proof, nodes used).

    A node is a choice that was found to lead nowhere.  Bins are completed around the largest piece; once few pieces
    are left and no waste is, around the piece that has the fewest fillings, the largest of those.  The search without ``dive`` tries
    all undominated fillings; a dive tries some of them in an order drawn from its number, and so proves nothing.
    """
    spare = target * capacity - sum(n * c for n, c in counts.items())
    if spare < 0:
        return None, True, 0
    table, rnd = _Table(counts, capacity), random.Random(dive)
    most = max(1, -(-sum(counts.values()) // target) - 1) if dive % 2 else None  # every other dive: no bin of more pieces than the mean
    path: list[tuple[Pattern, int]] = []

    def around(spare: int) -> int | None:
        """The piece to complete a bin around; None if some piece has no filling."""
        largest = table.bits.bit_length() - 1
        if spare or len(table.counts) > FEW:
            return largest
        least, best = (table.bits & -table.bits).bit_length() - 1, None
        for n in sorted(table.counts, reverse=True):
            room = capacity - n
            if not room or room in table.counts and (room != n or table.counts[n] > 1):
                return n
            k = (table.bits & table.flip >> n & (1 << room // 2 + 1) - 1).bit_count()
            if k < FILLINGS and 3 * least <= room:
                one = ((n, 1),)
                table.take(one, 1)
                k = sum(1 for _ in islice(table.fillings(room, 0, most), FILLINGS))
                table.take(one, -1)
            if not k:
                return None
            if k == 1:
                return n
            if best is None or k < best[0]:
                best = k, n
        return best[1]

    def options(piece: int | None, spare: int):
        if piece is None:
            return
        one = ((piece, 1),)
        table.take(one, 1)
        ways = table.fillings(capacity - piece, spare, most)
        if dive:
            key = lambda x: (x[0], rnd.random() + 0.5 * len(x[1]) - (x[1][0] / capacity if x[1] else 0))
            ways = iter(sorted(islice(ways, 12 if dive % 4 < 2 else 64), key=key))
        while True:
            waste, way = next(ways, (None, ()))
            table.take(one, -1)
            if waste is None:
                return
            merged = Counter((piece, *way))
            pattern = tuple(sorted(merged.items(), reverse=True))
            times = min(table.counts[n] // k for n, k in pattern)
            if waste:
                times = min(times, spare // waste)
            while times:  # the bulk first; single bins make up any other number
                yield waste * times, pattern, times
                times //= 2
            table.take(one, 1)

    # Choices are made anew on the way back, so a level holds no table; a dive holds its few.
    stack: list[list] = [[spare, around(spare), 0, None]]
    used = 0
    while stack:
        level = stack[-1]
        if dive:
            level[3] = level[3] if level[3] is not None else list(options(level[1], level[0]))
            step = level[3][level[2]] if level[2] < len(level[3]) else None
        else:
            step = next(islice(options(level[1], level[0]), level[2], None), None)
        if step is None:
            used += 1
            if used > nodes:
                return None, False, used
            stack.pop()
            if path:
                table.take(path[-1][0], -path[-1][1])
                path.pop()
            continue
        level[2] += 1
        waste, pattern, times = step
        table.take(pattern, times)
        path.append((pattern, times))
        if not table.counts:
            return path, False, used
        stack.append([level[0] - waste, around(level[0] - waste), 0, None])
    return None, not dive, used


def searched(counts: dict[int, int], capacity: int, target: int, nodes: int = NODES) -> tuple[list[tuple[Pattern, int]] | None, bool]:
    """(packing into ``target`` bins or None, whether None is a proof); ``nodes`` bounds the search with all its dives."""
    share, dive = max(1, nodes // 64), 0
    while nodes > 0:
        found, proof, used = complete(counts, capacity, target, min(nodes, share), dive)
        if found is not None or proof:
            return found, proof
        nodes -= max(1, used)
        dive += 1
        if dive % 8 == 0:
            share *= 2
    return None, False


def least(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs, after Martello and Toth: for each smallest size that counts, pieces that can stand beside none of that size
    or over fill their bins alone, others over half have a bin each, and the pieces up to half must fit into what those leave or into more bins."""
    lengths = sorted(n for n, c in counts.items() if c)
    number, tokens = [0], [0]  # of the pieces shorter than each place's
    for n in lengths:
        number.append(number[-1] + counts[n])
        tokens.append(tokens[-1] + n * counts[n])
    half = bisect_right(lengths, capacity // 2)
    best = number[-1] - number[half]
    for k, size in enumerate(lengths[:half]):
        alone = bisect_right(lengths, capacity - size)
        room = (number[alone] - number[half]) * capacity - (tokens[alone] - tokens[half])
        best = max(best, number[-1] - number[half] + max(0, -(-(tokens[half] - tokens[k] - room) // capacity)))
    return best


def packed(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[Pattern, int]], str]:
    """Patterns with multiplicities that hold every piece of the length table, and "optimal" or "bound reached".

    "optimal": no packing has fewer bins, by the bound on waste or by a search that came to its end; "bound reached": ``nodes`` ran out first.
    """
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return [], "optimal"
    best, proved = best_fit(counts, capacity), True
    size = lambda x: sum(times for _, times in x)
    target = bound = least(counts, capacity)
    while target < size(best):  # the bound itself, then halfway to the incumbent
        nodes -= nodes // 2  # each target gets half of what is left
        better, proof = searched(counts, capacity, target, nodes)
        if better is None:
            bound, proved = target + 1, proved and proof
        else:
            best = better
        target = (bound + size(best)) // 2
    return best, "optimal" if proved else "bound reached"


def slots(patterns: list[tuple[Pattern, int]], capacity: int):
    """Arrays by (length, first rank): key, first sequence, how many a bin, first offset; keys ascend."""
    import numpy as np

    rows, base, taken = [], 0, {}
    for pattern, times in patterns:
        offset = 0
        for length, each in pattern:
            first = taken.get(length, 0)
            taken[length] = first + each * times
            rows.append((length, first, base, each, offset))
            offset += length * each
        base += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return table


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, salts: int = SALTS) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset, outcome; a length is dealt to ``salts`` tasks, or more of a large table.

    outcome is "optimal" or "bound reached", as ``packed`` tells it of the whole packing, the same in every row.
    """
    rows = written(pieces(docs, path, id_col, text_col, capacity, end_id))
    salts = max(salts, rows.count() // PART)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    by_salt = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))  # at most capacity * salts rows
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    patterns, outcome = packed(counts, capacity)
    table = slots(patterns, capacity)
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_salt.select("length", "_salt", before.alias("_first"))
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row", "piece")) - 1 + F.col("_first")
    ranked = rows.join(first, ["length", "_salt"]).select("_id", "piece", "start", "length", "ids_crc32", rank.alias("_rank"))

    def place(batches):
        import numpy as np
        import pyarrow as pa

        keys = [(int(a), int(b)) for a, b in table[:, :2]]
        starts = {}
        for k, (length, _) in enumerate(keys):
            starts.setdefault(length, k)
        order = np.array(sorted(starts), dtype=np.int64)
        low = np.array([starts[n] for n in order.tolist()] + [len(keys)], dtype=np.int64)
        for batch in batches:
            length = batch.column(3).to_numpy()
            rank_ = batch.column(5).to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                k = int(np.searchsorted(order, n))
                a, b = low[k], low[k + 1]
                here = length == n
                at[here] = a + np.searchsorted(table[a:b, 1], rank_[here], side="right") - 1
            slot = table[at]
            past = rank_ - slot[:, 1]
            sequence = slot[:, 2] + past // slot[:, 3]
            offset = slot[:, 4] + past % slot[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = ranked.mapInArrow(tidied(place), f"_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("_id", id_col).withColumn("outcome", F.lit(outcome))
