"""Token counts without token ids.

A pre-token here is a run without ASCII white space, which the tokenizer's own
pre-tokenizer never joins with another.  Spark counts the pre-tokens of all documents
(those that repeat within a task are sent), tokenises the most
frequent ones once, ``shared_entries`` at most, and sends the table of their pieces to the tasks as sorted
arrays.  There it is joined to each document's pre-token frequencies and summed; a
pre-token that is not in the table is tokenised once for the task that meets it (a
table of ``cache_entries``, started anew when full).  Documents are never shuffled, and
no sequence of ids for a document ever exists.

Defined results: null text counts as empty (0 bytes, 0 tokens); special strings
inside a text count as the library's default has them (one token); repeated rows
each get their own result row; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import scratch as S

#: Pre-tokens of the shared table: 16 bytes each in a task.
SHARED = 1_000_000
#: Pre-tokens that a task counts before it sends those it met twice.
PENDING = 150_000


def frequent_pretokens(docs: DataFrame, entries: int) -> DataFrame:
    """(hash, word, n) of the most frequent pre-tokens, ``entries`` at most, counted in tasks that meet them twice or more."""

    def run(batches):
        h, n, spelt = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def send():
            often = n > 1
            for at in range(0, int(often.sum()), 50_000):
                part = slice(at, at + 50_000)
                yield S.batch(hash=K.signed(h[often][part]), word=S.pa.array(spelt[often][part].tolist(), S.pa.binary()), n=n[often][part])

        for rows in batches:
            for _, _, data, offsets in K.pieces(rows.column(0)):
                words = K.Words(data, offsets)
                new, one, count = np.unique(words.hash, return_index=True, return_counts=True)
                raw = data.tobytes()
                text = np.array([raw[a:b] for a, b in zip(words.start[one].tolist(), words.end[one].tolist())], object)
                both, first, which = np.unique(np.concatenate([h, new]), return_index=True, return_inverse=True)
                n = np.bincount(which, np.concatenate([n, count]), minlength=len(both)).astype(np.int64)
                h, spelt = both, np.concatenate([spelt, text])[first]
                if len(h) > PENDING:
                    yield from send()
                    h, n, spelt = h[:0], n[:0], spelt[:0]
        yield from send()
        S.release()

    S.ship(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "hash long, word binary, n long")
    counted = S.Scratch(docs.sparkSession).write(found.groupBy("hash").agg(F.sum("n").alias("n"), F.first("word").alias("word")).withColumn("level", F.floor(16 * F.log2("n")).cast("int")), "counted")
    # the least level (a sixteenth of a doubling) above which at most ``entries`` lie, by a histogram of a thousand bins or so
    least, above = None, 0
    for r in sorted(counted.groupBy("level").agg(F.count("*").alias("words")).collect(), reverse=True):
        above += r["words"]
        if above > entries:
            break
        least = r["level"]
    return counted.where(F.col("level") >= least if least is not None else F.lit(False)).select("hash", "word", "n")


def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def _pieces(tokenizer, words: list[str], at_once: int = 2048) -> list[int]:
    """Numbers of pieces, a few words at a time: an encoding holds far more than its length."""
    return [len(x) for i in range(0, len(words), at_once) for x in tokenizer.encode_batch_fast(words[i : i + at_once], add_special_tokens=False)]


def pretoken_pieces(words: DataFrame, tokenizer_file: str) -> DataFrame:
    """(hash, pieces) of (hash, word)."""

    def run(batches):
        tokenizer = _tokenizer(tokenizer_file)
        for rows in batches:
            count = _pieces(tokenizer, [w.decode("utf-8", "replace") for w in rows.column(1).to_pylist()])
            yield S.pa.RecordBatch.from_arrays([rows.column(0), S.pa.array(count, S.pa.int64())], names=["hash", "pieces"])
        S.release()

    S.ship(words.sparkSession)
    return words.select("hash", "word").mapInArrow(run, "hash long, pieces long")


class Pieces:
    """Piece counts by sorted hash."""

    def __init__(self):
        self.hash, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, h: np.ndarray, count: np.ndarray) -> None:
        both = np.concatenate([self.hash, h])
        order = np.argsort(both, kind="stable")
        self.hash, self.count = both[order], np.concatenate([self.count, count])[order]

    def join(self, h: np.ndarray, out: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Fills ``out`` where a hash of ``todo`` (places in h) is known; the places that are left."""
        if not len(self.hash) or not len(todo):
            return todo
        at = np.minimum(np.searchsorted(self.hash, h[todo]), len(self.hash) - 1)
        found = self.hash[at] == h[todo]
        out[todo[found]] = self.count[at[found]]
        return todo[~found]


def count_tokens(docs: DataFrame, tokenizer_file: str, limit: int = 2048, shared_entries: int = SHARED, cache_entries: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) for each row of ``docs``."""
    scratch = S.Scratch(docs.sparkSession)
    docs = S.texts_of(docs)
    words = scratch.write(frequent_pretokens(docs, shared_entries), "frequent")
    t = pretoken_pieces(words.repartition("hash"), tokenizer_file).toArrow()  # at most shared_entries rows
    shared = Pieces()
    shared.add(K.unsigned(t.column("hash").to_numpy()), t.column("pieces").to_numpy())
    table = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        tokenizer, own = _tokenizer(tokenizer_file), Pieces()
        for rows in batches:
            n_bytes, n_tokens = [], []
            for _, _, data, offsets in K.pieces(rows.column(1)):
                words = K.Words(data, offsets)
                distinct, one, which = np.unique(words.hash, return_index=True, return_inverse=True)
                pieces = np.zeros(len(distinct), np.int64)
                new = own.join(distinct, pieces, table.value.join(distinct, pieces, np.arange(len(distinct))))
                if len(new):
                    raw = data.tobytes()
                    spelt = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.start[one[new]].tolist(), words.end[one[new]].tolist())]
                    pieces[new] = _pieces(tokenizer, spelt)
                    if len(own.hash) + len(new) > cache_entries:
                        own = Pieces()
                    own.add(distinct[new], pieces[new])
                n_bytes.append(np.diff(offsets))
                n_tokens.append(K.per_text(pieces[which] if len(which) else which, words.first))
            if n_bytes:
                total = np.concatenate(n_tokens).astype(np.int64)
                yield S.batch(doc_id=rows.column(0), n_bytes=np.concatenate(n_bytes).astype(np.int64), n_tokens=total, over_limit=total > limit)
        S.release()

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def naive_token_counts(texts: list[str | None], tokenizer_file: str) -> list[int]:
    """Brute force for tests: each whole text is encoded."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file)
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]
