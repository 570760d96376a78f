"""Toxicity by weak supervision.

Voters.  Lexicon entries are words and word beginnings.  Some are fixed; the rest
are mined from a bounded sample of labelled rows outside the held-out fold.  The
entries are dealt to ``n_lexicons`` voters that vote toxic when a text holds one
of theirs; pattern voters look at how many distinct entries occur, how dense they
are, and at shouting; one voter says "not toxic" of longer texts without entries.

Label model.  The votes of every document outside the held-out fold are counted by
pattern (at most 3**voters patterns).  Expectation-maximisation fits a
tree-augmented generative model to the pattern counts: each voter's accuracy, and
for the strongest conditional dependencies (a maximum spanning tree of conditional
mutual information) the correlation with one other voter.  Its posteriors are the
training labels.

Classifier.  A sparse linear model on hashed words and word beginnings is trained
on the posteriors of the bounded sample by FTRL with an L1 penalty, and scores
every whole text.  Labels, language, source and doc_id never enter a score.

Defined results: null and empty texts have no features and score the intercept;
rows with a null label teach nothing; without labelled rows the fixed lexicon alone
votes; repeated rows each get a result row; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm import linear as L
from tessera.llm import scratch as S
from tessera.llm.quality import fold, labelled_sample

#: Common English insults, each a lexicon entry.
INSULTS = ("idiot", "moron", "scum", "stupid", "loser", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin", "bastard", "dumb", "filth")
STEMS = (4, 5, 6, 7, 8)
#: Training of the classifier, at any sample size: the L1 penalty for each labelled row, and the passes.
L1_PER_ROW = 0.0006
EPOCHS = 4
BITS = 22
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
_ASCII_UPPER = np.zeros(256, np.int64)
_ASCII_UPPER[65:91] = 1


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, words in text): slots of lower-cased words, and of the first 4 to 8 bytes of longer ones."""
    start, end = K.word_bounds(data, offsets, K.ALNUM)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    sums, inverse = K.prefix_sums(data, lower=True, seed=5)
    docs, slots = [], []

    def add(a, b, d, salt):
        h = K.mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) + np.uint64(salt << 32))
        docs.append(d)
        slots.append((h >> np.uint64(64 - BITS)).astype(np.int64))

    add(start, end, doc, 0)
    for n in STEMS:
        m = end - start > n
        add(start[m], start[m] + n, doc[m], n)
    return np.concatenate(docs), np.concatenate(slots), np.diff(first)


def fixed_slots() -> np.ndarray:
    data = np.frombuffer("".join(INSULTS).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in INSULTS])])
    doc, slot, _ = word_features(data, offsets)
    return np.unique(slot[: len(INSULTS)])


def mine_lexicon(docs: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Slots that occur in at least 4 toxic texts and nearly only there, by a one-sided score."""
    if not len(labels) or not labels.any() or labels.all():
        return np.zeros(0, np.int64)
    counts = [np.bincount(np.concatenate([d for d, y in zip(docs, labels) if y == c] or [np.zeros(0, np.int64)]), minlength=1 << BITS).astype(np.float64) for c in (0, 1)]
    clean, toxic = counts[0] / (labels == 0).sum(), counts[1] / (labels == 1).sum()
    lift = np.log((toxic + 1e-4) / (clean + 1e-4))
    score = np.where((counts[1] >= 4) & (lift > np.log(12)), counts[1] * lift, 0)
    best = np.argsort(-score, kind="stable")[:size]
    return np.sort(best[score[best] > 0])


class Voters:
    def __init__(self, lexicon: np.ndarray, n_lexicons: int):
        self.lexicon, self.n_lexicons = np.sort(lexicon), n_lexicons
        self.owner = (K.mix64(self.lexicon.astype(np.uint64)) % np.uint64(n_lexicons)).astype(np.int64)
        self.n = n_lexicons + 4

    def votes(self, doc: np.ndarray, slot: np.ndarray, words: np.ndarray, shouting: np.ndarray) -> np.ndarray:
        """(texts, voters) of ABSTAIN, CLEAN, TOXIC."""
        n = len(words)
        out = np.zeros((n, self.n), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, slot), max(len(self.lexicon) - 1, 0))
        hit = self.lexicon[at] == slot if len(self.lexicon) else np.zeros(len(slot), bool)
        hit_doc, entry = doc[hit], at[hit]
        out[hit_doc, self.owner[entry]] = TOXIC
        pair = np.unique(hit_doc * (len(self.lexicon) + 1) + entry)
        distinct = np.bincount(pair // (len(self.lexicon) + 1), minlength=n)
        hits = np.bincount(hit_doc, minlength=n)
        k = self.n_lexicons
        out[:, k] = np.where(distinct >= 3, TOXIC, np.where(words >= 5, np.where(distinct == 0, CLEAN, ABSTAIN), ABSTAIN))
        out[:, k + 1] = np.where(hits * 200 >= np.maximum(words, 1), np.where(hits > 0, TOXIC, ABSTAIN), np.where(words >= 20, CLEAN, ABSTAIN))
        out[:, k + 2] = np.where((distinct == 0) & (words >= 50), CLEAN, ABSTAIN)
        out[:, k + 3] = np.where(shouting & (hits > 0), TOXIC, ABSTAIN)
        return out

    def pack(self, votes: np.ndarray) -> np.ndarray:
        return votes @ (3 ** np.arange(self.n, dtype=np.int64))

    def unpack(self, pattern: np.ndarray) -> np.ndarray:
        return pattern[:, None] // 3 ** np.arange(self.n, dtype=np.int64) % 3


def piece_votes(voters: Voters, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    doc, slot, words = word_features(data, offsets)
    upper = np.concatenate([[0], np.cumsum(_ASCII_UPPER[data])])
    shouting = 3 * (upper[offsets[1:]] - upper[offsets[:-1]]) > np.diff(offsets)
    return voters.pack(voters.votes(doc, slot, words, shouting))


class LabelModel:
    """Tree-augmented generative model of the votes, fitted by expectation-maximisation on pattern counts."""

    def __init__(self, votes: np.ndarray, count: np.ndarray, rounds: int = 40, prior: float = 0.1):
        m = votes.shape[1]
        score = (votes == TOXIC).sum(1) - (votes == CLEAN).sum(1)
        post = np.where(score > 0, 0.9, 0.05).astype(np.float64)
        self.prior, self.parent = prior, np.full(m, -1)
        one = np.eye(3)[votes]  # pattern, voter, vote
        for step in range(rounds):
            weight = np.stack([count * (1 - post), count * post], 1)
            self.prior = float(np.clip(weight[:, 1].sum() / max(weight.sum(), 1e-9), 1e-3, 0.6))
            pair = np.einsum("pc,pia,pjb->cijab", weight, one, one) + 0.05  # class, voter, voter, vote, vote
            single = np.einsum("pc,pia->cia", weight, one) + 0.15
            if step % 10 == 0:
                self.parent = self._tree(pair, single)
            self.single = single / single.sum(-1, keepdims=True)
            self.given = pair / pair.sum(-2, keepdims=True)  # of i's vote given j's
            new = self.posterior(votes)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new

    def _tree(self, pair: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Maximum spanning tree of the class-conditional mutual information: which votes depend on each other."""
        p = pair / pair.sum((-1, -2), keepdims=True)
        s = single / single.sum(-1, keepdims=True)
        share = np.clip([1 - self.prior, self.prior], 1e-3, 1)
        self.dependence = np.einsum("c,cij->ij", share, (p * np.log(p / (s[:, :, None, :, None] * s[:, None, :, None, :]))).sum((-1, -2)))
        m = len(self.dependence)
        parent, inside = np.full(m, -1), [0]
        while len(inside) < m:
            rest = [i for i in range(m) if i not in inside]
            i, j = max(((i, j) for i in rest for j in inside), key=lambda x: (self.dependence[x], -x[0], -x[1]))
            parent[i] = j if self.dependence[i, j] > 1e-3 else -1
            inside.append(i)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for i, j in enumerate(self.parent):
            for c in (0, 1):
                log[:, c] += np.log(self.single[c, i, votes[:, i]] if j < 0 else self.given[c, i, j, votes[:, i], votes[:, j]])
        return L.sigmoid(log[:, 1] - log[:, 0])

    def accuracies(self) -> np.ndarray:
        """P(vote is right | voter votes), for each voter."""
        joint = self.single * np.array([1 - self.prior, self.prior])[:, None, None]
        return (joint[0, :, CLEAN] + joint[1, :, TOXIC]) / np.maximum(joint[:, :, 1:].sum((0, 2)), 1e-12)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_train: int = 8000, lexicon_size: int = 600, n_lexicons: int = 6, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out (false for a null doc_id), score, predicted."""
    spark = docs.sparkSession
    docs = S.texts_of(docs)

    def sample_features(rows):
        for first, end, data, offsets in K.pieces(rows.column(1)):
            doc, slot, words = word_features(data, offsets)
            d, s, _ = K.unique_in_text(doc, slot.astype(np.uint64))
            upper = np.concatenate([[0], np.cumsum(_ASCII_UPPER[data])])
            shouting = 3 * (upper[offsets[1:]] - upper[offsets[:-1]]) > np.diff(offsets)
            own = slice(first, end)
            yield S.batch(doc_id=rows.column(0)[own], label=rows.column(2)[own], slots=K.list_array(s.astype(np.int32), np.bincount(d, minlength=end - first)), words=words.astype(np.int64), shouting=shouting)

    sample = labelled_sample(docs, labels, "toxic", max_train, folds, held_out)
    t = S.arrow_map(sample, sample_features, "doc_id long, label int, slots array<int>, words long, shouting boolean").toArrow()
    lists = t.column("slots").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    order = np.lexsort((np.diff(at), t.column("doc_id").to_numpy()))
    slots = [flat[at[i] : at[i + 1]] for i in order]
    y = t.column("label").to_numpy()[order]
    mined = mine_lexicon(slots, y, lexicon_size)
    voters = Voters(np.union1d(fixed_slots(), mined), n_lexicons)
    lexicon = spark.sparkContext.broadcast(voters)

    def patterns(rows):
        packed = np.concatenate([piece_votes(lexicon.value, data, offsets) for _, _, data, offsets in K.pieces(rows.column(1))])
        key, n = np.unique(packed, return_counts=True)
        yield S.batch(pattern=key, n=n.astype(np.int64))

    open_rows = docs.where(F.coalesce(fold("doc_id", folds) != held_out, F.lit(True)))
    found = S.arrow_map(open_rows, patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()  # at most 3**voters rows
    key, n = found.column("pattern").to_numpy(), found.column("n").to_numpy()
    order_p = np.argsort(key)
    model = LabelModel(voters.unpack(key[order_p]), n[order_p].astype(np.float64)) if len(key) else None

    if model is not None and len(slots):
        doc = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
        votes = voters.votes(doc, np.concatenate(slots) if slots else flat, t.column("words").to_numpy()[order], t.column("shouting").to_numpy(zero_copy_only=False)[order])
        target = model.posterior(votes)
        rows = [(s, np.ones(len(s)), float(p)) for s, p in zip(slots, target)]
        weights, intercept = L.train_ftrl(rows, BITS, alpha=0.3, l1=L1_PER_ROW * len(rows), epochs=EPOCHS)
    else:
        weights, intercept = np.zeros(1 << BITS, np.float32), -2.0
        weights[fixed_slots()] = 4.0
    kept = np.flatnonzero(weights)
    sparse = spark.sparkContext.broadcast((kept, weights[kept]))  # at most 2**BITS, far fewer under L1

    def score(rows):
        at, w = sparse.value
        out = []
        for first, end, data, offsets in K.pieces(rows.column(1)):
            doc, slot, _ = word_features(data, offsets)
            where = np.minimum(np.searchsorted(at, slot), max(len(at) - 1, 0))
            hit = at[where] == slot if len(at) else np.zeros(len(slot), bool)
            pair = np.unique(doc[hit] * (len(at) + 1) + where[hit])
            out.append(L.sigmoid(intercept + np.bincount(pair // (len(at) + 1), w[pair % (len(at) + 1)], minlength=end - first)))
        yield S.batch(doc_id=rows.column(0), score=np.concatenate(out))

    scored = S.arrow_map(docs, score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
