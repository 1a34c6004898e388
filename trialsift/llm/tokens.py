"""Token ids of whole texts as the tokenizers library gives them, with a bounded memory of pieces met before."""

from __future__ import annotations

VOCABULARY = "byte_bpe_50k.json"
_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian 16-bit strings; equal to encoding each text whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        from trialsift.llm.bpe_tree import Vocabulary

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.pieces = Vocabulary(path, specials=False)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        for row, ids, bounds in self.pieces.encode([t.encode() for t in texts]):
            raw, at = ids.astype("<u2").tobytes(), (2 * bounds).tolist()
            for k, (a, b) in enumerate(zip(at, at[1:]), row):
                out[k] = out[k] + raw[a:b] if out[k] else raw[a:b]
        return out


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
