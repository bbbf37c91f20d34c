"""Pieces of pre-tokens of the lower-casing word BPE vocabulary, each distinct pre-token being encoded once per worker."""

from __future__ import annotations

import os
import re

import numpy as np

from . import common

#: Texts of these characters normalise and pre-split by plain rules; all others by the library's own.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's own pre-split pattern, on lower-cased plain texts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Distinct pre-tokens that a worker keeps; then it starts anew. Bounds memory, changes no result.
KEEP = 250_000
#: First characters of keys that stand for special strings, and for pre-tokens that the library made.
SPECIAL, OTHER = "\x01", "\x02"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordPieces:
    """pieces[word]: the ids of a pre-token as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, as keys of pieces: of a plain text the words themselves; of any other what the library's
        own normaliser and pre-tokenizer make of the text between special strings, and those."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        out: list[str] = []
        for part in self.special.split(text) if self.added else [text]:
            if part in self.added:
                out.append(SPECIAL + part)
            elif part:
                out += [OTHER + piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Makes sure that the pieces of all these pre-tokens are known."""
        new = [w for w in words if w not in self.pieces]
        if new and len(self.pieces) + len(new) > KEEP:
            self.pieces.clear()
            new = list(words)
        for w in [w for w in new if w[0] in SPECIAL + OTHER]:
            ids = [self.added[w[1:]]] if w[0] == SPECIAL else [t.id for t in self.library.model.tokenize(w[1:])]
            self.pieces[w] = np.array(ids, "<u4").tobytes()
        new = [w for w in new if w[0] not in SPECIAL + OTHER]
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(cuts) == len(some):
                data, at = ids.tobytes(), 0
                for w, to in zip(some, cuts.tolist()):
                    self.pieces[w] = data[at:to]
                    at = to
            else:
                for w in some:
                    self.pieces[w] = self.encode(w)


@common.worker_cache
def word_pieces(path: str) -> WordPieces:
    """One per Python worker."""
    return WordPieces(path)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """For each text, its ids as little-endian unsigned 32-bit integers, as the library gives them."""
    known = word_pieces(path)
    split = [known.split(t) for t in texts]
    known.learn({w for words in split for w in words})
    get = known.pieces.__getitem__
    return [b"".join(map(get, words)) for words in split]
