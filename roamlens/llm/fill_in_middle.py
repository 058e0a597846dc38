"""Fill-in-the-middle transformation with cuts found in a wavelet matrix.

Each code point has a class (blank, line break, other; the end of a text is one more).
The symbol of a position joins its class and the next one's, so a unit's last code
point is known by its symbol alone: a word ends at (other, blank), (other, break) and
(other, end), a tail of white space at (blank, end) and (break, end).

The symbols of a run of texts stand in a wavelet matrix: one bit vector for each of
the four bits, each level sorted stably by the bits above, with the number of ones
before each block of 512 positions.  The rank of a symbol before a position walks down
the levels.  The sum of the ranks of the symbols that end a unit counts the boundaries
before a position: their number in a whole text is the number of its units, and the
end of the k-th unit is found by bisection on these counts, for all cuts of the run at
once.  Cuts land on code points, so a text is put together again without a change.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roamlens.llm.common import text_chunks, utf8

END, BLANK, BREAK, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[[0x20, 0x09]] = BLANK
CLASSES[[0x0A, 0x0B, 0x0C, 0x0D]] = BREAK

#: The symbols (class, next class) that end a unit.
UNITS = {
    "words": ((OTHER, BLANK), (OTHER, BREAK), (OTHER, END), (BLANK, END), (BREAK, END)),
    "lines": ((BREAK, BLANK), (BREAK, OTHER), (BREAK, BREAK), (BREAK, END), (BLANK, END), (OTHER, END)),
}
SEED = 42
PERCENT = 50
SPM_PERCENT = 80
MARKS = ("<P>", "<S>", "<M>")


class BitVector:
    """Packed bits; ``rank`` counts the ones before positions, ``select`` finds them."""

    BLOCK = 512

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        blocks = self.n // self.BLOCK + 1
        self.packed = np.zeros(blocks * self.BLOCK // 8, np.uint8)
        part = np.packbits(bits)
        self.packed[:len(part)] = part
        ones = np.bitwise_count(self.packed.reshape(blocks, -1)).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        block, rest = np.divmod(at, self.BLOCK)
        byte = np.arange(self.BLOCK // 8)
        bits = np.clip(rest[:, None] - 8 * byte, 0, 8)  # bits that count, of each byte of the block
        mask = (0xFF00 >> bits).astype(np.uint8)
        inside = self.packed.reshape(-1, self.BLOCK // 8)[block] & mask
        return self.before[block] + np.bitwise_count(inside).sum(axis=1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th one (from 0)."""
        block = np.searchsorted(self.before, k, "right") - 1
        bits = np.unpackbits(self.packed.reshape(-1, self.BLOCK // 8)[block], axis=1)
        upto = np.cumsum(bits, axis=1, dtype=np.int64)
        return block * self.BLOCK + np.argmax(upto > (k - self.before[block])[:, None], axis=1)


class WaveletMatrix:
    """Ranks of small symbols in a sequence."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n, self.bits, self.zeros = levels, len(symbols), [], []
        for level in range(levels - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            self.bits.append(BitVector(one))
            self.zeros.append(self.n - int(np.count_nonzero(one)))
            symbols = np.concatenate((symbols[~one], symbols[one]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each position."""
        low, high = np.zeros(len(at), np.int64), at
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            a, b = bits.rank(low[:1])[:1], bits.rank(high)
            if symbol >> (self.levels - 1 - k) & 1:
                low, high = np.broadcast_to(zeros + a, len(at)), zeros + b
            else:
                low, high = np.broadcast_to(low[:1] - a, len(at)), high - b
        return high - low


class Boundaries:
    """The unit ends of a run of texts.  Positions are code points of all texts in a row."""

    def __init__(self, texts: list[bytes], unit: str = "words"):
        data = np.frombuffer(b"".join(texts), np.uint8)
        lead = (data & 0xC0) != 0x80  # the first byte of each code point
        self.starts = BitVector(lead)
        bytes_before = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        self.first = self.starts.rank(bytes_before)
        self.n_bytes = len(data)
        symbols = CLASSES[data[lead]]
        after = np.zeros(len(symbols), np.uint8)
        after[:-1] = symbols[1:]
        after[self.first[1:][np.diff(self.first) > 0] - 1] = END
        self.matrix = WaveletMatrix(symbols << 2 | after, 4)
        self.ends = [a << 2 | b for a, b in UNITS[unit]]
        self.before = self.count(self.first)
        self.units = np.diff(self.before)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Unit ends before each position: the ranks of the symbols that end one."""
        return sum(self.matrix.rank(s, at) for s in self.ends)

    def cut(self, text: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The position after the first k units of each named text, by bisection."""
        low, high = self.first[text], self.first[text + 1]
        goal = self.before[text] + k
        while np.any(low < high):
            mid = (low + high) // 2
            enough = self.count(mid) >= goal
            low, high = np.where(enough, low, np.minimum(mid + 1, high)), np.where(enough, mid, high)
        return low

    def byte(self, at: np.ndarray) -> np.ndarray:
        """The byte where each position begins, from the first byte of all texts."""
        out = np.full(len(at), self.n_bytes, np.int64)
        inside = at < self.first[-1]
        out[inside] = self.starts.select(at[inside])
        return out


def draws(doc_id: int | None, seed: int | str) -> list[int]:
    """Four numbers below 2**32 from the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transform(ids: list, texts: list[bytes], seed: int | str = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT,
              unit: str = "words", marks: tuple[str, str, str] = MARKS) -> dict[str, list]:
    """n, form, the characters of prefix and middle, and the output of each text."""
    found, (p, s, m) = Boundaries(texts, unit), [x.encode() for x in marks]
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    n = found.units
    plain = np.array([not t or p in t or s in t or m in t for t in texts], bool) | (h[:, 2] % 100 >= percent)
    some = np.flatnonzero(~plain)
    one, two = h[some, 0] % (n[some] + 1), h[some, 1] % (n[some] + 1)
    a, b = found.cut(some, np.minimum(one, two)), found.cut(some, np.maximum(one, two))
    from_byte = found.byte(found.first[:-1][some])
    x, y = found.byte(a) - from_byte, found.byte(b) - from_byte
    out = {"n": n.tolist(), "form": ["plain"] * len(texts), "prefix_chars": [None] * len(texts), "middle_chars": [None] * len(texts),
           "output": list(texts)}
    for k, i in enumerate(some.tolist()):
        t = texts[i]
        prefix, middle, suffix = t[:x[k]], t[x[k]:y[k]], t[y[k]:]
        spm = h[i, 3] % 100 < spm_percent
        out["form"][i] = "spm" if spm else "psm"
        out["output"][i] = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
        out["prefix_chars"][i], out["middle_chars"][i] = int(a[k] - found.first[i]), int(b[k] - a[k])
    return out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int | str = SEED, percent: int = PERCENT,
                   spm_percent: int = SPM_PERCENT, unit: str = "words", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per row of ``docs``: id, n (units of the text), form (``plain``, ``psm`` or
    ``spm``), prefix_chars, middle_chars (null if plain) and output.

    ``percent`` of the texts are cut, ``spm_percent`` of these with the suffix first.  The
    draws depend on the id alone, so repeated ids are treated alike; a null id draws like
    an empty one.  A null text is empty; empty texts and texts with a mark stay plain.
    Other columns are not read."""
    import pyarrow as pa

    def batches(it):
        kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}
        for b in it:
            ids, texts = b.column(0), utf8(b.column(1))
            for at, part in text_chunks(texts):
                cols = transform(ids.slice(at, len(part)).to_pylist(), part, seed, percent, spm_percent, unit, marks)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(part)), *[pa.array(v, kinds[k]).cast(pa.string() if k == "output" else kinds[k]) for k, v in cols.items()]],
                    ["id", *cols])

    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    out = src.mapInArrow(batches, "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", out: str = "restored",
            marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The exact text, from output and form alone (null output: null)."""
    text, form = F.col(output_col), F.col(form_col)
    part = F.split(text, "|".join(rf"\Q{m}\E" for m in marks), -1)  # empty, then the three parts in the form's order
    psm = F.concat(part[1], part[3], part[2])
    spm = F.concat(part[2], part[3], part[1])
    return rows.withColumn(out, F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text))
