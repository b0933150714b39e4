"""Token ids of whole texts, with a cache of words.

The vocabulary's rules never join characters across white space, so a text has
the ids of its words between ASCII white space, one after the other. Words
repeat, and so do their parts; the ids of those met before come from caches of
bounded size. Texts are cut and their words numbered a run of texts at a time
by Arrow, so that only the distinct words of a run are looked up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import kept, texts, tidy

#: Words and parts that a Python worker keeps in each of two generations, and bytes of the longest of them.
WORDS, PARTS, LONGEST = 400_000, 150_000, 48
#: Bytes of the texts that are cut into words at once (one text at least), words and parts that are learned at once,
#: and words whose ids are put in place at once.
RUN_BYTES, LEARNED, PLACED = 1 << 21, 1 << 14, 1 << 16
END = 0
_END = END.to_bytes(4, "little")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words whose parts are cut here just as the tokenizer does: printable ASCII and Latin-1 letters.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|\n|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


_PLAIN_LINES = re.compile("[\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
#: Stands between the ids of words. No bytes of ids below 2**24 are like it, wherever they are cut.
_NEXT = b"\xff\xff\xff\xff"


class Recent(dict):
    """A cache of two generations: what the older one still serves moves to the younger."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def turn(self) -> None:
        """Starts a new generation if this one is full."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def recalled(self, keys: list) -> list:
        """What the older generation has for keys that the younger lacks, None where it has nothing."""
        found = list(map(self.older.get, keys))
        self.update((key, x) for key, x in zip(keys, found) if x is not None)
        return found

    def forget_long(self, keys: list) -> None:
        for key in keys:
            if len(key) > LONGEST:
                del self[key]


class Encoder:
    """Texts to bytes of little-endian unsigned 32-bit ids, as the tokenizer without special tokens gives them.

    Unseen words of plain characters are cut into letters, digits and signs by
    the vocabulary's own rule; only unseen parts go through its merges. All
    other words go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        known = self.whole.get_vocab(with_added_tokens=True)
        if max(known.values()) >= 1 << 24:
            raise ValueError("the vocabulary has ids above 2**24")
        self.last = np.zeros(max(known.values()) + 1, bool)  # the token ends its part
        self.last[[i for t, i in known.items() if t.endswith("</w>")]] = True
        self.words, self.parts = Recent(WORDS), Recent(PARTS)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder of this vocabulary, with the words that earlier tasks met."""
        made = kept(__name__)
        if path not in made:
            made[path] = cls(path)
        return made[path]

    def _learn_parts(self, parts: list[str]) -> None:
        """`parts`: LEARNED at most."""
        lines = [" ".join(parts[i : i + 256]) for i in range(0, len(parts), 256)]
        for i, found in enumerate(self.merges.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            own = parts[256 * i : 256 * (i + 1)]
            if len(ends) != len(own):
                raise ValueError("the vocabulary has no token for the end of every part")
            self.parts.update(zip(own, (data[a:b] for a, b in zip([0, *ends], ends))))

    def _learn(self, words: list[bytes]) -> None:
        lines = b"\n".join(words).decode()
        if not _PLAIN_LINES.fullmatch(lines) or "<|" in lines:
            odd = [w for w in words if not _PLAIN.fullmatch(w.decode()) or b"<|" in w]
            ids = self.whole.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)
            self.words.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(odd, ids))
            rest = set(odd)
            words = [w for w in words if w not in rest]
            lines = b"\n".join(words).decode()
        self.parts.turn()
        self.parts["\n"] = _NEXT
        cut = _PARTS.findall(lines.lower())
        found = list(map(self.parts.get, cut))
        places = [j for j, x in enumerate(found) if x is None]
        asked = list({cut[j] for j in places})
        unseen = [key for key, x in zip(asked, self.parts.recalled(asked)) if x is None]
        for i in range(0, len(unseen), LEARNED):
            self._learn_parts(unseen[i : i + LEARNED])
        for j in places:
            found[j] = self.parts[cut[j]]
        self.words.update(zip(words, b"".join(found).split(_NEXT)))
        self.parts.forget_long(unseen)

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the words, which differ."""
        self.words.turn()
        found = list(map(self.words.get, words))
        places = [j for j, x in enumerate(found) if x is None]
        asked = [words[j] for j in places]
        new = [key for key, x in zip(asked, self.words.recalled(asked)) if x is None]
        for i in range(0, len(new), LEARNED):
            self._learn(new[i : i + LEARNED])
        for j, ids in zip(places, map(self.words.get, asked)):
            found[j] = ids
        self.words.forget_long(new)
        return found

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        distinct = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.binary()))
        self.words[b""] = b""  # before and after white space at the ends of a text
        found = self._known(pc.binary_join(distinct, b"\n")[0].as_py().split(b"\n"))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins, own = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), "<u4")
        coded = coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(sizes[coded]))
        out = np.empty(ends[-1], "<u4")
        for low in range(0, len(coded), PLACED):
            which, bounds = coded[low : low + PLACED], ends[low : low + PLACED + 1]
            places = np.repeat(begins[which] - bounds[:-1], np.diff(bounds))
            out[bounds[0] : bounds[-1]] = own[places + np.arange(bounds[0], bounds[-1])]
        offsets = split.offsets.to_numpy()
        return out, ends[offsets[1:] - offsets[0]]

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(low, high, ids, ends) of the texts low to high - 1, of RUN_BYTES if they are more than one: their ids one
        after the other, and where each text's end. A null text is empty."""
        texts = texts.fill_null("")
        total, low = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
        while low < len(texts):
            most = RUN_BYTES + (total[low - 1] if low else 0)
            high = max(low + 1, int(np.searchsorted(total, most, side="right")))
            yield low, high, *self._run(texts[low:high])
            low = high

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out = []
        for _, _, ids, ends in self.runs(pa.array(texts, pa.string())):
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out


def map_pieces(docs: DataFrame, length: int, path: str, make, names: list[str], schema: str) -> DataFrame:
    """One row per piece of at most `length` ids of text plus END; `make(doc_id, piece, start, ids)` gives it.

    ids: the piece's bytes. A null text is empty.
    """
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            owners = batch.column("doc_id").to_pylist()
            for low, high, ids, ends in encoder.runs(batch.column("text")):
                rows, bounds = [], [0, *ends.tolist()]
                for doc, a, b in zip(owners[low:high], bounds, bounds[1:]):
                    data = ids[a:b].tobytes() + _END
                    for piece, start in enumerate(range(0, len(data) // 4, length)):
                        rows.append(make(doc, piece, start, data[4 * start : 4 * (start + length)]))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return texts(docs).mapInArrow(tidy(run), schema)
