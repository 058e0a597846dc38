"""Sub-word pieces of a SentencePiece model by a shared-prefix forward pass.

A text is marked (spaces become ``▁``, one is put in front) and cut into units at
places that no piece of the vocabulary spans.  The distinct units of many texts are
sorted, so that equal prefixes are neighbours, and walked depth-first as a trie: the
forward state of a prefix (the piece its best segmentation ends with) is computed
once for all units that begin with it.

* Unigram models: the Viterbi state is the best sum of scores.
* BPE models (the public model here): the sum of scores does not give the model's
  own segmentation.  The segmentation of a prefix is the one chain of pieces in which
  any two neighbours stay apart when they are merged on their own, so the state keeps
  the one last piece that is stable after the state it extends.

Characters without a piece become byte pieces (or the unknown id).  Each worker
keeps the units it has seen; nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from roamlens.llm.common import Kept, text_chunks

MARK = "▁"
#: Texts whose units are sorted and walked together (bytes).
TRIE_BYTES = 2_000_000
#: Units (in each of two generations) and pairs of pieces kept by a worker.
MOST_KEPT, MOST_PAIRS = 150_000, 400_000
#: Ids decoded together.
RUN_IDS = 1 << 18


class Pieces:
    """The vocabulary: normal pieces with scores, and byte pieces."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], byte_ids: list[int] | None, unk_id: int,
                 bpe: bool, add_prefix: bool = True):
        self.scores, self.ids, self.byte_ids, self.unk_id = scores, ids, byte_ids, unk_id
        self.bpe, self.add_prefix = bpe, add_prefix
        #: The pieces read backwards as a trie: a node's piece is at the empty key.
        self.ends: dict = {}
        for s in scores:
            node = self.ends
            for c in reversed(s):
                node = node.setdefault(c, {})
            node[""] = s
        self.kept = Kept(MOST_KEPT)
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.unit = self._units()
        #: The bytes of each id.
        self.names = [b""] * (max([unk_id, *ids.values(), *(byte_ids or [])]) + 1)
        for p, i in ids.items():
            self.names[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids or []):
            self.names[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = range(sp.get_piece_size())
        normal = [i for i in n if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(sp.is_byte(i) for i in n) else None
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        kind = proto.trainer_spec.model_type
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in normal}, {sp.id_to_piece(i): i for i in normal}, byte_ids,
                   sp.unk_id(), kind == pb.TrainerSpec.BPE, spec.add_dummy_prefix)

    def _units(self) -> re.Pattern:
        """Marks with letters, or marks with others, where no piece mixes the two."""
        out: set[str] = set()
        while True:
            letter = rf"[^\W\d_{re.escape(''.join(sorted(out)))}]" if out else r"[^\W\d_]"
            is_letter = re.compile(letter).match
            odd = {c for p in self.scores for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:])
                   if bool(is_letter(a)) != bool(is_letter(b)) for c in (a, b) if is_letter(c)}
            odd_marks = any(MARK in p.lstrip(MARK) for p in self.scores)
            if odd_marks or any(c.isalpha() for c in odd):
                return re.compile("(?s).+" if odd_marks else rf"{MARK}*[^{MARK}]+|{MARK}+")
            if not odd:
                other = rf"[^\w{MARK}]++|[\d_{re.escape(''.join(sorted(out)))}]++"
                return re.compile(rf"{MARK}*{letter}+|{MARK}*(?:{other})++|{MARK}+")
            out |= odd

    # --- BPE: which neighbours stay apart

    def merge(self, s: str) -> list[str]:
        """The segmentation of a short string by merging its best pair again and again."""
        parts, score = list(s), self.scores.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                x = score(parts[i] + parts[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def stable(self, before: str, piece: str) -> bool:
        after = self.pairs.get(before)
        if after is None:
            after = self.pairs[before] = {}
        found = after.get(piece)
        if found is None:
            if self.n_pairs > MOST_PAIRS:
                self.pairs, self.n_pairs, after = {}, 0, {}
                self.pairs[before] = after
            found = after[piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
            self.n_pairs += 1
        return found

    # --- the forward pass

    def _extend(self, s: str, i: int, last: list[str], score: list[float]) -> None:
        """The state of the prefix that ends with character ``i`` of ``s``."""
        node, at, found = self.ends, i, []
        while at >= 0 and (node := node.get(s[at])) is not None:  # pieces that end here, short to long
            at -= 1
            if "" in node:
                found.append(node[""])
        if self.bpe:
            for piece in reversed(found):
                k = len(piece)
                if k == 1:
                    break
                before = last[i - k] if i >= k else ""
                if self.stable(before if before in self.scores else "", piece):
                    last.append(piece)
                    return
            last.append(s[i])  # a character alone, with a piece or not
            return
        best, value = s[i], self.scores.get(s[i], -1e9) + (score[i - 1] if i else 0.0)
        for piece in found:
            k = len(piece)
            x = self.scores[piece] + (score[i - k] if i >= k else 0.0)
            if x > value:
                best, value = piece, x
        last.append(best)
        score.append(value)

    def walk(self, units: list[str]) -> dict[str, list[str]]:
        """The pieces of each of the sorted distinct units."""
        out, last, score, before = {}, [], [], ""
        for s in units:
            same, most = 0, min(len(before), len(s))
            while same < most and before[same] == s[same]:
                same += 1
            del last[same:], score[same:]  # the walk climbs to the common prefix
            for i in range(same, len(s)):
                self._extend(s, i, last, score)
            parts, i = [], len(s)
            while i:
                parts.append(last[i - 1])
                i -= len(last[i - 1])
            out[s], before = parts[::-1], s
        return out

    def numbers(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode()]
            else:
                out.append(self.unk_id)
        return out

    def mark(self, text: str) -> str:
        return ((" " if self.add_prefix and text else "") + text).replace(" ", MARK)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.unit.findall(self.mark(t)) for t in texts]
        new = sorted(self.kept.missing(set().union(*cut)))
        self.kept.now.update((s, np.array(self.numbers(p), "<i4").tobytes()) for s, p in self.walk(new).items())
        of = self.kept.now.get
        return [np.frombuffer(b"".join(map(of, units)), "<i4") for units in cut]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.names.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    """One vocabulary for each Python worker, kept between tasks."""
    return Pieces.load(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``ids``, the piece ids of its whole
    text.  Null or empty texts have none; ids pass as they are, null or repeated;
    other columns are not read."""
    import pyarrow as pa

    def batches(it):
        vocabulary = pieces(model)
        for b in it:
            texts = [x or "" for x in b.column(1).to_pylist()]
            sized = [x.encode() for x in texts]
            for at, part in text_chunks(sized, TRIE_BYTES):
                found = vocabulary.encode_all(texts[at:at + len(part)])
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), ids], ["id", "ids"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = src.mapInArrow(batches, f"id {src.schema[0].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its piece ids in ``text_col`` (null and empty lists:
    empty; a column of that name is replaced)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    src = encoded.select(*[c for c in encoded.columns if c != text_col])
    place = src.columns.index(ids_col)

    def batches(it):
        vocabulary = pieces(model)
        for b in it:
            lists = b.column(place)
            starts, flat = lists.offsets.to_numpy(), lists.values
            whole, at = lists.is_valid().to_numpy(zero_copy_only=False), 0
            while at < len(lists):  # a run of rows, not the whole batch as Python numbers
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + RUN_IDS, "right")) - 1)
                to = min(to, len(lists))
                ids = flat.slice(starts[at], starts[to] - starts[at]).to_pylist()
                cut = (starts[at:to + 1] - starts[at]).tolist()
                texts = [vocabulary.decode(ids[x:y]) if ok else "" for x, y, ok in zip(cut[:-1], cut[1:], whole[at:to])]
                yield pa.RecordBatch.from_arrays([*b.slice(at, to - at).columns, pa.array(texts, pa.string())],
                                                 [*b.schema.names, text_col])
                at = to

    return src.mapInArrow(batches, T.StructType([*src.schema.fields, T.StructField(text_col, T.StringType())]))
