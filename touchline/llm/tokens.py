"""Token ids of whole texts, fast and exact.

The contract's ids are those of ``tokenizers`` for a vocabulary file.  A byte-level BPE vocabulary says
the same thing as a table of ranks (bytes of a token -> its place in the order of merges), for which
``tiktoken`` has an encoder several times as fast.  Both give the same ids if

* the merges' results stand in the vocabulary in the order of the merges, and
* every token, encoded alone by the merges, is itself.

The second condition makes the two procedures equal: until tokens x and y of some span join, nothing
has crossed the span's ends, so what happened inside is what happens to the span's bytes alone; if the
joined bytes are a token, that token's own encoding joins x and y too, and so do the merges.  Both
conditions are checked when a vocabulary is loaded; one that fails them, and any text that the fast
encoder refuses, goes to ``tokenizers``.

Special tokens' strings inside a text are ordinary text (``encode_special_tokens``), so no document can
smuggle a control token into a sequence.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Fixed value: how byte-level BPE cuts a text into pieces that merges don't cross.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves,
    the others, in order, for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked(tok, path: str):
    """A fast encoder with the ids of ``tok``, read from ``path``; None if it can't be shown to have them."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, cut = whole["model"], whole.get("pre_tokenizer") or {}
    plain_cut = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    plain_model = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte, vocab = _byte_of(), model["vocab"]
    if not plain_cut or not plain_model or whole.get("normalizer") or not all(c in byte for w in vocab for c in w) or not all(c in vocab for c in byte):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = np.array([vocab[a + b] for a, b in merges])
    if len(made) + 256 != len(vocab) or (np.diff(made) <= 0).any():
        return None
    alone = Tokenizer(tok.model).encode_batch_fast(list(vocab), add_special_tokens=False)
    if any(e.ids != [i] for e, i in zip(alone, vocab.values())):
        return None
    return tiktoken.Encoding("touchline", pat_str=PIECES, mergeable_ranks={bytes(byte[c] for c in w): i for w, i in vocab.items()}, special_tokens={})


class Encoder:
    """``ids(text)``: the ids of a text; null is empty."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.fast = ranked(self.tok, path)

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its regex has a bounded stack: some endless runs of white space
                pass
        return self.plain(text)


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
