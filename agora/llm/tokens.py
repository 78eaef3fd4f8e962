"""Token ids of whole texts, inside tasks.

``WordwiseEncoder`` gives exactly the ids that the tokenizers library gives for the whole text, but asks the
library only for words it has not met.  Every pre-tokenizer here starts a new piece at a space between two
characters that are not white space, and keeps a line feed between two such characters apart; no merge crosses a
piece.  So the ids of a text are the ids of the stretches between such places, one after the other.  A word of plain
letters before plain signs is two pieces as well.

Texts are taken in slices of bounded size.  Arrow splits a slice into words and numbers the different ones; only
those are looked up one by one, and numpy puts their ids in the order of the text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import give_back

_CUT = re.compile(r" (?<=\S )(?=\S)")
#: White space that is not a single space or line feed between two other characters (for Arrow's regular expressions).
_UNSURE = r"[\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
#: A word that every pre-tokenizer here cuts between its letters and its signs.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%&#$*|<>]*)")
SLICE_BYTES = 4 << 20


class WordwiseEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.  ``kept`` bounds the number of words remembered."""

    def __init__(self, path: str, kept: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._of = Tokenizer.from_file(path)
        added = self._of.get_added_tokens_decoder().values()
        # An added token could take the space on which we cut, and a post-processor could add ids to each part.
        self._wordwise = self._of.post_processor is None and not any(t.lstrip or t.rstrip or t.normalized for t in added)
        self._kept = kept // 2
        #: Ids of words as they follow a space, or a line feed if they begin with one; those of late and those before.
        self._late: dict[str, bytes] = {}
        self._early: dict[str, bytes] = {}
        self._tails: dict[str, bytes] = {}
        self._line_feed = self._whole("\n")
        #: Whether case, or what white space stands before a word, makes no difference.
        self._folds = self._whole("ÀÖØÞA") == self._whole("àöøþa")
        self._alike = not self._line_feed and self._whole(" a") == self._whole("a")
        # Which ids end a word, or else begin one with a space before it: many words are encoded in one call and told apart by these.
        suffix = getattr(self._of.model, "end_of_word_suffix", None)
        space = self._of.id_to_token(int(first[0])) if len(first := np.frombuffer(self._whole(" "), "<u4")) == 1 else None
        told = (lambda t: t.endswith(suffix)) if suffix else (lambda t: t.startswith(space)) if space else (lambda t: False)
        self._told = np.zeros(self._of.get_vocab_size() + 1, bool)
        self._told[[i for t, i in self._of.get_vocab().items() if told(t)]] = True
        self._after = 1 if suffix else 0

    def _whole(self, text: str) -> bytes:
        return self._each([text])[0]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self._of.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of each of some plain words with a space before it."""
        ids = np.asarray(self._of.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self._told[ids]) + self._after
        if len(cuts) != len(words):
            return self._each([" " + w for w in words])
        data, cuts = ids.tobytes(), [0, *cuts.tolist()] if self._after else [*cuts.tolist(), len(ids)]
        return [data[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Adds the ids of words that no table has; those of words with signs behind them are returned instead."""
        late, early = self._late, self._early
        plain, odd, tailed = {}, [], []
        for word in words:
            found = _PLAIN.fullmatch(word, 1 if word[:1] == "\n" else 0)
            if found is None:
                odd.append(word)
                continue
            if tail := found[2]:
                stem = word[: -len(tail)]
            if tail or self._folds:
                stem = (stem if tail else word).lower() if self._folds else stem
                tailed.append((word, stem, tail))
                if stem in late:
                    continue
                if (known := early.get(stem)) is not None:
                    late[stem] = known
                    continue
                word = stem
            plain[word] = None
        spaced = [w for w in plain if w[0] != "\n"]
        for start in range(0, len(spaced), 512):
            some = spaced[start : start + 512]
            late.update(zip(some, self._spaced(some)))
        odd += [w for w in plain if w[0] == "\n"]
        for start in range(0, len(odd), 512):
            some = odd[start : start + 512]
            ids = self._each([w[1:] if w[:1] == "\n" else " " + w for w in some])
            late.update((w, self._line_feed + i if w[:1] == "\n" else i) for w, i in zip(some, ids))
        composed = {}
        for word, stem, tail in tailed:
            if tail not in self._tails:
                if len(self._tails) > 10_000:
                    self._tails.clear()
                self._tails[tail] = self._whole("a" + tail)[len(self._whole("a")) :]
            composed[word] = late[stem] + self._tails[tail]
        return composed

    def _values(self, words: list[str]) -> list[bytes]:
        """The ids of different words.  Words not met for long are forgotten, others move to the table of late ones."""
        if len(self._late) > self._kept:
            self._early, self._late = self._late, {}
        late, early = self._late, self._early
        new = []
        for word in words:
            if word not in late:
                if (known := early.get(word)) is None:
                    new.append(word)
                else:
                    late[word] = known
        composed = self._learn(new) if new else {}
        return [i if (i := late.get(w)) is not None else composed[w] for w in words]

    def _split(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the different words, ids in each of them, words of the texts as places in these, first word of each text)."""
        broken = pc.replace_substring(texts, "\n", " " if self._alike else " \n")
        if not self._alike:
            broken = pc.binary_join_element_wise(pa.scalar("\n"), broken, pa.scalar(""))
        lists = pc.split_pattern(broken, " ")
        words = lists.flatten().dictionary_encode()
        values = self._values(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        return values, np.fromiter(map(len, values), np.int64, len(values)) // 4, words.indices.to_numpy(), lists.offsets.to_numpy()

    def _odd(self, text: str) -> bytes:
        """The ids of a text with unusual white space."""
        first, *rest = _CUT.split(text)
        return self._whole(first) + b"".join(self._values_of(rest))

    def _values_of(self, words: list[str]) -> list[bytes]:
        known: dict[str, bytes] = {}
        for start in range(0, len(words), 100_000):
            new = [w for w in dict.fromkeys(words[start : start + 100_000]) if w not in known]
            known.update(zip(new, self._values(new)))
        return [known[w] for w in words]

    def _slices(self, column: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Slices of texts of bounded size, and which texts of each are odd."""
        column = pc.fill_null(column.cast(pa.string()), "")
        upto = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
        start = 0
        while start < len(column):
            end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE_BYTES, side="right")))
            texts = column.slice(start, end - start)
            odd = pc.match_substring_regex(texts, _UNSURE).to_numpy(zero_copy_only=False) if self._wordwise else np.ones(len(texts), bool)
            yield texts, odd
            start = end
        give_back()  # workers stay alive beside the executor between tasks

    def ids_of(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each whole text; a null or empty text has none."""
        whole = self._odd if self._wordwise else self._whole
        for texts, odd in self._slices(column):
            usual = texts.filter(pa.array(~odd)) if odd.any() else texts
            values, lengths, words, firsts = self._split(usual)
            begin = np.cumsum(lengths) - lengths
            own = lengths[words]
            ends = np.concatenate([[0], np.cumsum(own)])
            places = np.repeat(begin[words] - ends[:-1], own)
            places += np.arange(len(places))
            data = np.frombuffer(b"".join(values), "<u4")[places].tobytes()
            starts, ends = 4 * ends[firsts[:-1]] + len(self._line_feed), 4 * ends[firsts[1:]]
            found = iter(zip(starts.tolist(), ends.tolist()))
            for place, other in enumerate(odd.tolist()):
                if other:
                    yield whole(texts[place].as_py())
                else:
                    a, b = next(found)
                    yield data[a:b]

    def counts_of(self, column: pa.Array) -> Iterator[int]:
        """The number of ids of each whole text."""
        whole = self._odd if self._wordwise else self._whole
        for texts, odd in self._slices(column):
            usual = texts.filter(pa.array(~odd)) if odd.any() else texts
            _, lengths, words, firsts = self._split(usual)
            upto = np.concatenate([[0], np.cumsum(lengths[words])])[firsts]
            found = iter((np.diff(upto) - len(self._line_feed) // 4).tolist())
            for place, other in enumerate(odd.tolist()):
                yield len(whole(texts[place].as_py())) // 4 if other else next(found)

    def __call__(self, text: str | None) -> bytes:
        return next(self.ids_of(pa.array([text], pa.string())))


@lru_cache(maxsize=4)
def encoder(path: str, kept: int = 500_000) -> WordwiseEncoder:
    """One encoder for a vocabulary file and Python worker."""
    return WordwiseEncoder(path, kept)


def public_path(name: str) -> str:
    """Where the driver finds a public vocabulary file; executors have the same package at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)
