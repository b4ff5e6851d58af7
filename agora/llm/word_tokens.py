"""Token ids of many texts at once, remembering the ids of each distinct piece of a word."""

from __future__ import annotations

import os

import numpy as np

from agora.llm.words import Hasher, bounds, joined

PIECES_KEPT = 250_000
STEP_BYTES = 1 << 19
MARK = b"\x00"

# Classes of bytes. Letters and digits in ASCII; the two-byte
# letters from U+00C0 to U+00FF begin with C3, and 97 and B7 behind it are signs.
LETTER, DIGIT, SIGN, ODD = 0, 1, 2, 3
CLASS = np.full(256, ODD, np.int8)
CLASS[0x21:0x7F] = SIGN
CLASS[0x30:0x3A] = DIGIT
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = LETTER
CLASS[0x27] = ODD  # an apostrophe may join what follows
LEAD, TIMES, DIVIDED = 0xC3, 0x97, 0xB7
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class WordTokens:
    """Token ids of texts.

    The tokenizer drops white space and splits there; a word of Latin letters,
    digits and signs (no apostrophe, no <|) it splits wherever the class
    changes, and at each digit, and it reads letters in lower case. So a text's
    ids are its pieces' ids in turn. Such plain pieces are encoded without the
    tokenizer's own normalising and splitting, other words by the whole
    tokenizer. Pieces are told apart by two 64-bit hashes; if ever the first
    alone collides, the step is encoded text by text. The memory is bounded:
    beyond PIECES_KEPT, pieces that only one step has used go.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.mark_id, = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.hashes = Hasher(0), Hasher(1)
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)  # sorted by key
        self.first, self.count, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        self.ids = np.zeros(0, np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids end)."""
        buffer, text_starts = joined(texts)
        buffer, starts, ends, plain = split_pieces(buffer)
        key, check = (h(buffer, starts, ends) for h in self.hashes)
        own, where, back = np.unique(key, return_index=True, return_inverse=True)
        if not np.array_equal(check[where][back], check):
            return self.encode_texts(texts)
        at, known = self.find(own)
        if not np.array_equal(self.check[at[known]], check[where[known]]):
            return self.encode_texts(texts)
        if len(new := where[~known]):
            data = buffer.tobytes()
            self.learn([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], plain[new], own[~known], check[new])
            at, _ = self.find(own)
        self.uses[at] += 1
        at = at[back]
        counts = self.count[at]
        past = np.cumsum(counts)
        ids = self.ids[np.repeat(self.first[at] - (past - counts), counts) + np.arange(past[-1] if len(past) else 0)]
        pieces_past = np.append(np.searchsorted(starts, text_starts[1:]), len(starts))
        text_ends = np.append(0, past)[pieces_past]
        if len(self.key) > PIECES_KEPT:
            self.forget()
        return ids, text_ends

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = [self.tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts]
        return np.array(sum(coded, []), np.uint32), np.cumsum([len(c) for c in coded])

    def forget(self) -> None:
        """Keep the pieces that two steps have used, or none if these are too many."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > PIECES_KEPT // 2:
            keep = keep[:0]
        counts = self.count[keep]
        past = np.cumsum(counts)
        self.ids = self.ids[np.repeat(self.first[keep] - (past - counts), counts) + np.arange(past[-1] if len(past) else 0)]
        self.key, self.check, self.first, self.count = self.key[keep], self.check[keep], past - counts, counts
        self.uses = np.zeros(len(keep), np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key among those known, whether it is there)."""
        if not len(self.key):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return at, self.key[at] == keys

    def learn(self, pieces: list[bytes], plain: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Encode new pieces, some hundreds to a call.

        Plain ones close with an id that ends a word. Others have a mark in
        between, a control character that is one id as a word; pieces that hold
        it go alone.
        """
        other = np.flatnonzero(~plain).tolist()
        kinds = [(self.plain, np.flatnonzero(plain).tolist(), b" ", 1000),
                 (self.tokenizer, [k for k in other if MARK not in pieces[k]], b" " + MARK + b" ", 500),
                 (self.tokenizer, [k for k in other if MARK in pieces[k]], b"", 1)]
        first, count, ids, used = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), [self.ids], len(self.ids)
        for tokenizer, places, gap, most in kinds:
            for k in range(0, len(places), most):
                lot = places[k:k + most]
                text = gap.join([pieces[p] for p in lot]).decode()
                own = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                if tokenizer is self.plain:
                    past = np.flatnonzero(self.closes[own]) + 1
                    begin = np.append(0, past[:-1])
                else:
                    past = np.append(np.flatnonzero(own == self.mark_id) if most > 1 else [], len(own)).astype(np.int64)
                    begin = np.append(0, past[:-1] + 1)
                if len(begin) != len(lot):
                    raise ValueError("the tokenizer does not split where words end")
                first[lot], count[lot] = begin + used, past - begin
                ids.append(own)
                used += len(own)
        self.ids = np.concatenate(ids)
        at = np.searchsorted(self.key, key)  # both are sorted
        self.key, self.check = np.insert(self.key, at, key), np.insert(self.check, at, check)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.uses = np.insert(self.uses, at, 0)


def split_pieces(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer with plain words in lower case, start and end of each piece, whether it is plain)."""
    starts, ends = bounds(buffer)
    kind = CLASS[buffer]
    after = np.append(buffer[1:], np.uint8(0))
    lead = np.flatnonzero((buffer == LEAD) & (after >= 0x80) & (after <= 0xBF))
    second = buffer[lead + 1]
    kind[lead] = kind[lead + 1] = np.where((second == TIMES) | (second == DIVIDED), SIGN, LETTER)
    special = (buffer == 0x3C) & (after == 0x7C)  # <| may begin a special token
    odd = np.append(0, np.cumsum((kind == ODD) | special, dtype=np.int64))
    plain_word = odd[ends] == odd[starts]
    low = LOWER[buffer]
    upper = (second >= 0x80) & (second <= 0x9E) & (second != TIMES)
    low[lead[upper] + 1] += 0x20
    plain = np.zeros(len(buffer) + 1, np.int8)
    plain[starts[plain_word]] = 1
    plain[ends[plain_word]] -= 1
    plain = np.cumsum(plain[:-1], dtype=np.int8) > 0  # of each byte: part of a plain word
    low = np.where(plain, low, buffer)
    cut = np.zeros(len(buffer), bool)
    cut[1:] = plain[1:] & plain[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    at = np.flatnonzero(cut)
    piece_starts, piece_ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    return low, piece_starts, piece_ends, plain[piece_starts]


def of_process(path: str) -> WordTokens:
    """The process's own WordTokens for ``path``: a reused Python worker keeps what earlier tasks have learned."""
    import tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    kept = tokenizers.__dict__.setdefault("_word_tokens_of_process", {})
    if path not in kept:
        kept[path] = WordTokens(path)
    return kept[path]
