"""Sequence tagger: a linear-chain CRF over token features. It is trained on a bounded sample of sentences and applied sentence by sentence."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import combinations, pairwise
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.operators import tokens as tok

PAD = "<PAD>"


def shape(word: str) -> str:
    return "".join("#" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-" for c in word)


def _word(w: str) -> list[str]:
    """The features of a word by itself: affixes, case, digits, punctuation, shapes."""
    low, form, inner = w.lower(), shape(w), w[1:-1]
    out = [f"prefix{n}={low[:n]}" for n in range(1, 6)] + [f"suffix{n}={low[-n:]}" for n in range(1, 6)]
    checks = {"upper": w.isupper(), "title": w.istitle(), "digit": w.isdigit(), "digits": any(map(str.isdigit, w)), "digit inside": any(map(str.isdigit, inner)), "mark inside": any(not c.isalnum() for c in inner), "upper inside": any(map(str.isupper, inner)), "ascii": w.isascii()}
    return out + [f"is {name}" for name, yes in checks.items() if yes] + [f"shape={form}", f"short={re.sub(r'(.)\1+', r'\1', form)}"]


def wide_features(words: list[str]) -> list[list[str]]:
    """Two words to each side with their two and three word runs, the word itself, and its sentence."""
    low = [PAD, PAD, *map(str.lower, words), PAD, PAD]
    depth = sum(w in "([{" for w in words if w) - sum(w in ")]}" for w in words if w)
    sentence = [f"end={words[-1] in ('.', '!', '?')}", f"length={len(words)}", f"open={depth > 0}"] if words else []
    out = []
    for i, w in enumerate(words):
        near = low[i : i + 5]
        runs = [f"w{n}.{k}={'|'.join(near[k : k + n])}" for n in (1, 2, 3) for k in range(6 - n)]
        out.append(["bias", *runs, *sentence, *_word(w)])
    return out


def narrow_features(words: list[str]) -> list[list[str]]:
    """The word, its endings and case, the words beside it, and the ends of the sentence."""
    one = lambda w: [f"{w.lower()}", *(f"is {k}" for k, yes in (("upper", w.isupper()), ("title", w.istitle()), ("digit", w.isdigit())) if yes)]
    out = []
    for i, w in enumerate(words):
        f = ["bias", f"suffix3={w[-3:]}", f"suffix2={w[-2:]}", *(f"0:{x}" for x in one(w))]
        f += [f"-1:{x}" for x in one(words[i - 1])] if i else ["first"]
        f += [f"+1:{x}" for x in one(words[i + 1])] if i + 1 < len(words) else ["last"]
        out.append(f)
    return out


#: The features of a sentence by name, from its words.
_SENTENCE = {
    "sent.len(sent)": len,
    "sent.end_mark": lambda words: bool(words) and words[-1].strip() in ("!", "?", "."),
    "sent.has_unmatched_bracket": lambda words: sum(w in "([{" for w in words if w) != sum(w in ")]}" for w in words if w),
}


#: The features of described() that a word has by itself, by name.
_OWN = {f"suffix[-{m}:]": lambda w, m=m: w.lower()[-m:] for m in range(1, 6)} | {f"prefix[:{m}]": lambda w, m=m: w.lower()[:m] for m in range(1, 6)}
_OWN |= {
    "word.isupper()": str.isupper, "word.istitle()": str.istitle, "word.isdigit()": str.isdigit, "word.contains_digit": lambda w: any(map(str.isdigit, w)), "word.is_ascii": str.isascii,
    "word.has_upper_inside": lambda w: any(map(str.isupper, w[1:])), "word.has_punct_inside": lambda w: any(c in string.punctuation for c in w[1:]), "word.has_digit_inside": lambda w: any(map(str.isdigit, w[1:])),
    "word.pos_tag": lambda w: "", "shape.long": shape, "shape.short": lambda w: re.sub(r"(.)\1+", r"\1", shape(w)),
}


def described(words: list[str], pos: list[str], kinds: list[str | None] | None = None) -> list[dict]:
    """The wide features by name, with parts of speech and entity types from a tagger outside: for each word 56 of them.

    Runs of one to three lower-cased words, and of their parts of speech, among two to each side; the word with the parts of speech around
    it; the sentence's length, end and brackets; affixes, flags and shapes of the word. White space in strings is spelled out.
    """
    sentence = {name: f(words) for name, f in _SENTENCE.items()}
    low, tags = [PAD, PAD, *map(str.lower, words), PAD, PAD], [PAD, PAD, *pos, PAD, PAD]
    sides = {"p-1": (1,), "p0": (2,), "p1": (3,), "p-1p0": (1, 2), "p0p1": (2, 3), "p-1p1": (1, 3), "p-1p0p1": (1, 2, 3)}
    sizes = {"uni": 1, "bi": 2, "tri": 3}
    out = []
    for i, w in enumerate(words):
        f = {f"{name}[-2:2].{size}.{k}": "|".join(row[i + k : i + k + m]) for name, row in (("bow", low), ("pos", tags)) for size, m in sizes.items() for k in range(6 - m)}
        f |= {f"bowpos.w0{side}": "|".join([low[i + 2], *(tags[i + k] for k in at)]) for side, at in sides.items()} | sentence
        f |= {f"suffix[-{m}:]": low[i + 2][-m:] for m in range(1, 6)} | {f"prefix[:{m}]": low[i + 2][:m] for m in range(1, 6)}
        inner, form = w[1:], shape(w)
        f |= {"word.isupper()": w.isupper(), "word.istitle()": w.istitle(), "word.isdigit()": w.isdigit(), "word.contains_digit": any(map(str.isdigit, w))}
        f |= {"word.has_upper_inside": any(map(str.isupper, inner)), "word.has_punct_inside": any(c in string.punctuation for c in inner), "word.has_digit_inside": any(map(str.isdigit, inner))}
        f |= {"word.is_ascii": w.isascii(), "word.ner_tag": kinds[i] if kinds else None, "word.pos_tag": pos[i], "shape.long": form, "shape.short": re.sub(r"(.)\1+", r"\1", form)}
        out.append({k: _spelled(v) for k, v in f.items()})
    return out


def described_briefly(words: list[str], pos: list[str]) -> list[dict]:
    """The narrow features by name: the word, its endings, case and part of speech, those of the words beside it, and the ends of the sentence."""
    case = lambda w: {"word.lower()": w.lower(), "word.istitle()": w.istitle(), "word.isupper()": w.isupper()}
    part = lambda p: {"pos_tag": p, "pos_tag[:2]": p[:2]}
    out = []
    for i, w in enumerate(words):
        f = {"bias": 1.0, "word[-3:]": w[-3:], "word[-2:]": w[-2:], "word.isdigit()": w.isdigit()} | case(w) | part(pos[i])
        for side, end in ((-1, "BOS"), (1, "EOS")):
            if 0 <= i + side < len(words):
                f |= {f"{side:+d}:{k}": v for k, v in (case(words[i + side]) | part(pos[i + side])).items()}
            else:
                f[end] = True
        out.append({k: _spelled(v) for k, v in f.items()})
    return out


def _spelled(value):
    return re.sub(r"\s", "#SPACE", value.replace("\n", "#NEWLINE")) if isinstance(value, str) else value


def feature_rows(rows: DataFrame, words_col: str = "words", pos_col: str = "pos", kinds_col: str | None = None) -> DataFrame:
    """(doc, sent_id, i, features as text by name) for sentences with parallel arrays of words and parts of speech; the latter from any tagger, "" without one."""
    columns = [F.col("doc"), F.col("sent_id"), F.col(words_col), F.col(pos_col) if pos_col in rows.columns else F.transform(words_col, lambda _: F.lit("")), F.col(kinds_col) if kinds_col else F.lit(None).cast("array<string>")]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                words, pos, types = (b.column(c)[k].as_py() for c in (2, 3, 4))
                made = [[(name, v if isinstance(v, str) else str(v).lower()) for name, v in f.items() if v is not None] for f in described(words or [], pos or [], types)]
                n = len(made)
                same = [pa.array([b.column(c)[k].as_py()] * n, b.column(c).type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(n), pa.int32()), pa.array(made, pa.map_(pa.string(), pa.string()))], ["doc", "sent_id", "i", "features"])

    named = [c.alias(n) for c, n in zip(columns, ("doc", "sent_id", "words", "pos", "kinds"), strict=True)]
    return rows.select(*named).mapInArrow(run, f"doc {kinds['doc']}, sent_id {kinds['sent_id']}, i int, features map<string,string>")


def feature_counts(docs: DataFrame, names: list[str], text_col: str = "text", language: str = "plain") -> DataFrame:
    """(feature, value, n): how often the named features of described(), without parts of speech, take each value among the tokens that count.

    Tokens that count hold no white space or metadata, which sentences need to part, so a document's are taken as one sentence. What a word
    has by itself is worked out once for each different word held; no token leaves the workers.
    """
    sent = [n for n in names if n in _SENTENCE]
    near = [n for n in names if n.startswith(("bow", "pos"))]
    own = [n for n in names if n in _OWN]
    text_of = lambda v: v if isinstance(v, str) else str(v).lower()

    def packed(total: Counter) -> pa.RecordBatch:
        keys = list(total)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(total.values(), pa.int64())], ["feature", "value", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = language == "plain"
        find = re.compile(tok.PLAIN_WORDS if plain else tok.PATTERNS[language]).findall
        total: Counter = Counter()
        seen: Counter = Counter()

        def settle() -> pa.RecordBatch:
            for w, n in seen.items():
                for name in own:
                    total[name, text_of(_spelled(_OWN[name](w)))] += n
            out = packed(total)
            seen.clear()
            total.clear()
            return out

        for b in batches:
            for text in b.column(0):
                words = find(text.as_py() or "")
                if not plain:
                    words = [t for t in words if t[0] not in tok._BLANK and not t.startswith("===")]
                if own:
                    seen.update(words)
                for name in sent if words else ():
                    total[name, text_of(_SENTENCE[name](words))] += len(words)
                for f in described(words, [""] * len(words)) if near else ():
                    total.update((name, text_of(f[name])) for name in near)
                if len(seen) + len(total) > 1 << 18:
                    yield settle()
        yield settle()

    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(run, "feature string, value string, n long")
    return rows.groupBy("feature", "value").agg(F.sum("n").alias("n"))


FEATURES = {"wide": wide_features, "narrow": narrow_features}


def ignored(words: list[str]) -> bool:
    """Metadata: sentences that start with === are neither learnt nor tagged."""
    return bool(words) and words[0].startswith("===")


@dataclass
class Model:
    """Weights of features (rows of `rows`) by label, and of label pairs; row 0 of `pairs` is the start of a sentence."""

    labels: list[str]
    rows: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray
    features: str

    def scores(self, words: list[str]) -> np.ndarray:
        known = [[self.rows[f] for f in fs if f in self.rows] for fs in FEATURES[self.features](words)]
        return np.array([self.weights[k].sum(0) for k in known])

    def tag(self, words: list[str]) -> list[str]:
        """The likeliest labels: Viterbi."""
        if not words or ignored(words):
            return ["O"] * len(words)
        emit = self.scores(words)
        best, back = self.pairs[0] + emit[0], []
        for e in emit[1:]:
            through = best[:, None] + self.pairs[1:]
            back.append(through.argmax(0))
            best = through.max(0) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [self.labels[k] for k in reversed(path)]

    def tag_all(self, sentences: list[list[str]]) -> list[list[str]]:
        """tag() of many sentences at once; the sums run in the same order, so the labels are the same."""
        if self.features != "wide":
            return [self.tag(words) for words in sentences]
        out = [["O"] * len(words) for words in sentences]
        todo = sorted((k for k, words in enumerate(sentences) if words and not ignored(words)), key=lambda k: -len(sentences[k]))
        if not todo:
            return out
        length = np.array([len(sentences[k]) for k in todo])
        emit = self._emissions([sentences[k] for k in todo], length)
        first = np.cumsum(length) - length
        best, back = self.pairs[0] + emit[first], []
        path = np.empty(len(emit), np.int64)
        steps = int(length[0])
        many = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")  # sentences of that length or more
        ends = np.empty(len(todo), np.int64)
        for t in range(1, steps):
            m = int(many[t])
            ends[m : len(best)] = best[m:].argmax(1)
            through = best[:m, :, None] + self.pairs[1:]
            back.append(through.argmax(1).astype(np.int16))
            best = through.max(1) + emit[first[:m] + t]
        ends[: len(best)] = best.argmax(1)
        path[first + length - 1] = ends
        for t in range(steps - 1, 0, -1):
            at = first[: int(many[t])] + t
            path[at - 1] = back[t - 1][np.arange(len(at)), path[at]]
        for k, a, n in zip(todo, first.tolist(), length.tolist(), strict=True):
            out[k] = [self.labels[x] for x in path[a : a + n].tolist()]
        return out

    def _tables(self) -> tuple:
        """The kept runs of words as numbers: (number of a word, rows by place of words, codes and rows by place of pairs, of triples)."""
        if "_runs" not in self.__dict__:
            number: dict[str, int] = {PAD: 0}
            rows: list[dict] = [{}, {}, {}]
            for name, row in self.rows.items():
                if (m := re.match(r"w([123])\.([0-4])=", name)) is None:
                    continue
                n, k, text = int(m[1]), int(m[2]), name[m.end() :]
                bars = [i for i, c in enumerate(text) if c == "|"]
                for cuts in combinations(bars, n - 1):  # words may hold bars
                    ends = [-1, *cuts, len(text)]
                    words = [text[a + 1 : b] for a, b in pairwise(ends)]
                    if all(words):
                        key = tuple(number.setdefault(w, len(number)) for w in words)
                        rows[n - 1].setdefault(key, [-1] * (6 - n))[k] = row
            size = len(number) + 1  # the last: no word of any run
            runs = [np.full((size, 5), -1, np.int64)]
            for (i,), places in rows[0].items():
                runs[0][i] = places
            for found in rows[1:]:
                keys = sorted(found)
                codes = np.array([sum(x * size**j for j, x in enumerate(reversed(key))) for key in keys], np.int64)
                runs.append((codes, np.array([found[key] for key in keys], np.int64).reshape(len(keys), -1)))
            self._runs = (number, size, runs, {})
        return self._runs

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_runs"}

    def _emissions(self, sentences: list[list[str]], length: np.ndarray) -> np.ndarray:
        """scores() of all words, sentence after sentence."""
        number, size, (ones, twos, threes), known = self._tables()
        weights = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]))])  # the last row: a feature that isn't kept
        row = self.rows.get
        kinds: dict[str, int] = {}
        kind = np.array([kinds.setdefault(w, len(kinds)) for words in sentences for w in words])
        low = np.array([number.get(w.lower(), size - 1) for w in kinds])
        if len(known) > 200_000:
            known.clear()
        for w in kinds:
            if w not in known:
                known[w] = [r for f in _word(w) if (r := row(f, -1)) >= 0]
        own = np.full((len(kinds), max(1, max(len(known[w]) for w in kinds))), -1)
        for i, w in enumerate(kinds):
            own[i, : len(known[w])] = known[w]
        # words with two places of padding around each sentence
        at = np.arange(len(kind)) + 2 + 4 * np.repeat(np.arange(len(length)), length)
        padded = np.zeros(len(kind) + 4 * len(length), np.int64)
        padded[at] = low[kind]
        emit = np.zeros((len(kind), self.weights.shape[1]))
        emit += weights[row("bias", -1)]
        for k in range(5):
            emit += weights[ones[padded[at + k - 2], k]]
        for n, (codes, places) in ((2, twos), (3, threes)):
            here = padded[: len(padded) - n + 1]
            for j in range(1, n):
                here = here * size + padded[j : len(padded) - n + 1 + j]
            if not len(codes):
                continue
            spot = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
            hit = codes[spot] == here
            for k in range(6 - n):
                i = at + k - 2
                emit += weights[np.where(hit[i], places[spot[i], k], -1)]
        whole = []
        for words in sentences:
            depth = sum(w in "([{" for w in words) - sum(w in ")]}" for w in words)
            whole.append([row(f, -1) for f in (f"end={words[-1] in ('.', '!', '?')}", f"length={len(words)}", f"open={depth > 0}")])
        whole = np.repeat(np.array(whole), length, axis=0)
        for k in range(3):
            emit += weights[whole[:, k]]
        for k in range(own.shape[1]):
            emit += weights[own[kind, k]]
        return emit

    def marginals(self, words: list[str]) -> list[dict[str, float]]:
        """The probability of each label for each word; all on O for ignored sentences."""
        if not words or ignored(words):
            return [{k: float(k == "O") for k in self.labels} for _ in words]
        emit = self.scores(words)[None]
        p, _, _ = _expectations(emit, self.pairs, np.array([len(words)]))
        return [dict(zip(self.labels, map(float, q), strict=True)) for q in p[0]]

    def strongest(self, n: int = 30) -> pd.DataFrame:
        """(feature, label, weight) of the n highest and n lowest weights, ties by name."""
        names = list(self.rows)
        cells = pd.DataFrame([(names[r], self.labels[c], float(self.weights[r, c])) for r, c in zip(*np.nonzero(self.weights), strict=True)], columns=["feature", "label", "weight"])
        cells = cells.sort_values(["weight", "feature", "label"], ascending=[False, True, True])
        return pd.concat([cells.head(n), cells.iloc[n:].tail(n)])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


def _expectations(emit: np.ndarray, pairs: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities, expected label pairs (row 0: starts) and log partition of padded sentences: forward and backward in log space."""
    b, t, n = emit.shape
    step = pairs[1:]
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = pairs[0] + emit[:, 0]
    for i in range(1, t):
        ahead[:, i] = _lse(ahead[:, i - 1, :, None] + step, 1) + emit[:, i]
    inside = np.arange(t) < length[:, None]
    for i in range(t - 2, -1, -1):
        further = _lse(step[None] + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[:, i] = np.where(inside[:, i + 1, None], further, 0.0)
    whole = _lse(ahead[np.arange(b), length - 1], 1)
    p = np.exp(np.where(inside[:, :, None], ahead + behind - whole[:, None, None], -np.inf))  # padding may be beyond all numbers
    moves = np.zeros_like(pairs)
    moves[0] = p[:, 0].sum(0)
    for i in range(1, t):
        q = ahead[:, i - 1, :, None] + step + (emit[:, i] + behind[:, i])[:, None, :] - whole[:, None, None]
        moves[1:] += np.exp(np.where(inside[:, i, None, None], q, -np.inf)).sum(0)
    return p, moves, whole


def fit(sentences: list[tuple[list[str], list[str]]], features: str = "wide", c1: float = 0.1, c2: float = 0.1, rounds: int = 12, rate: float = 0.5, seed: int = 42, batch: int = 32) -> Model:
    """A CRF from sentences (words, labels): AdaGrad steps on the log likelihood with L1 (c1) and L2 (c2) penalties. Ignored and empty sentences don't count."""
    data = [(w, y) for w, y in sentences if w and not ignored(w)]
    labels = ["O", *sorted({x for _, y in data for x in y} - {"O"})]
    rows: dict[str, int] = {}
    coded = [([[rows.setdefault(f, len(rows)) for f in fs] for fs in FEATURES[features](w)], [labels.index(x) for x in y]) for w, y in data]
    n = len(labels)
    w, pairs = np.zeros((len(rows), n)), np.zeros((n + 1, n))
    sum_w, sum_p = np.full_like(w, 1e-8), np.full_like(pairs, 1e-8)
    order = sorted(range(len(coded)), key=lambda k: len(coded[k][1]))
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    draw = np.random.default_rng(seed)

    def shrink(v, g, scale):
        pace = rate / np.sqrt(scale)
        v = v - pace * g
        return np.sign(v) * np.maximum(np.abs(v) - pace * c1 / len(batches), 0) / (1 + pace * c2 / len(batches))

    for _ in range(rounds):
        for k in draw.permutation(len(batches)):
            part = [coded[j] for j in batches[k]]
            length = np.array([len(y) for _, y in part])
            b, t = len(part), int(length.max())
            at = np.array([(s, i, r) for s, (fs, _) in enumerate(part) for i, f in enumerate(fs) for r in f])
            place = at[:, 0] * t + at[:, 1]
            used, where = np.unique(at[:, 2], return_inverse=True)
            firsts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            emit = np.zeros((b * t, n))
            emit[place[firsts]] = np.add.reduceat(w[at[:, 2]], firsts, axis=0)
            p, moves, _ = _expectations(emit.reshape(b, t, n), pairs, length)
            for s, (_, y) in enumerate(part):
                p[s, np.arange(len(y)), y] -= 1
                np.subtract.at(moves, (np.r_[0, np.array(y[:-1], int) + 1], y), 1)
            error = p.reshape(b * t, n)[place]
            turn = np.argsort(where, kind="stable")
            g = np.add.reduceat(error[turn], np.flatnonzero(np.r_[True, np.diff(where[turn]) > 0]), axis=0)
            sum_w[used] += g**2
            sum_p += moves**2
            w[used] = shrink(w[used], g, sum_w[used])
            pairs = shrink(pairs, moves, sum_p)
    kept = np.flatnonzero(np.abs(w).sum(1))
    names = list(rows)
    return Model(labels, {names[k]: i for i, k in enumerate(kept)}, w[kept], pairs, features)


def sentences(labelled: DataFrame) -> DataFrame:
    """(doc, sent_id, words, labels) without white space, from tokens with sent_id and label."""
    rows = labelled.where(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) != "")
    per = rows.groupBy("doc", "sent_id").agg(F.array_sort(F.collect_list(F.struct("i", "text", "label"))).alias("s"))
    return per.select("doc", "sent_id", F.transform("s", lambda x: x["text"]).alias("words"), F.transform("s", lambda x: x["label"]).alias("labels"))


def sampled(rows: DataFrame, n: int = 5000, seed: int = 42, longest: int = 500) -> list[tuple[list[str], list[str]]]:
    """At most n sentences for training, the first by hash: the bound keeps the driver's share fixed.

    Up to half of them hold labels other than O, as these are rare in most corpora; the rest don't. Those of over `longest` words aren't learnt from.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc").cast("string"), F.col("sent_id").cast("string")))
    rows = rows.where(F.size("words") <= longest).withColumn("h", h).withColumn("rare", F.exists("labels", lambda x: x != "O"))
    first = lambda part, k: part.orderBy("h", "doc", "sent_id").limit(k).collect()
    rare = first(rows.where("rare"), n // 2)
    return [(list(r.words), list(r.labels)) for r in rare + first(rows.where("not rare"), n - len(rare))]


def fraction(rows: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """int(count * share) sentences, drawn without replacement by hash: exact, and nested for growing shares of one seed."""
    from veilquery.operators.corpus import split

    ids = rows.select(F.concat_ws("|", F.col("doc").cast("string"), F.col("sent_id").cast("string")).alias("sid"))
    chosen = split(ids, "sid", seed, (share, share)).where("part = 'train'").select("sid")
    return rows.join(chosen, F.concat_ws("|", F.col("doc").cast("string"), F.col("sent_id").cast("string")) == F.col("sid"), "left_semi")


def predict(tokens: DataFrame, model: Model) -> DataFrame:
    """tokens (doc, i, start, end, text, sent_id) with the model's label; white space gets O. Sentences go to Python in small batches, one at a time."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = dict(tokens.dtypes)["doc"]
    blank = F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) == ""
    per = tokens.where(~blank).groupBy("doc", "sent_id").agg(F.array_sort(F.collect_list(F.struct("i", "start", "end", "text"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for k in range(b.num_rows):
                s = b.column(2)[k].as_py()
                n = len(s)
                columns = [pa.array([b.column(0)[k].as_py()] * n, b.column(0).type), pa.array([b.column(1)[k].as_py()] * n, pa.int32())]
                columns += [pa.array([x[c] for x in s], t) for c, t in (("i", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(m.tag([x["text"] for x in s]), pa.string())], ["doc", "sent_id", "i", "start", "end", "text", "label"])

    tagged = per.mapInArrow(run, f"doc {kind}, sent_id int, i int, start int, end int, text string, label string")
    spaces = tokens.where(blank).select("doc", "sent_id", "i", "start", "end", "text", F.lit("O").alias("label"))
    return tagged.unionByName(spaces)


def flat_f1(gold: list[list[str]], predicted: list[list[str]]) -> float:
    """Micro F1 of token labels other than O."""
    pairs = [(g, p) for gs, ps in zip(gold, predicted, strict=True) for g, p in zip(gs, ps, strict=True)]
    right = sum(g == p != "O" for g, p in pairs)
    total = sum(g != "O" for g, _ in pairs) + sum(p != "O" for _, p in pairs)
    return 2 * right / total if total else 0.0


def _trials(spark: SparkSession, grid: pd.DataFrame, train: list, dev: list, features: str) -> DataFrame:
    """One task for each row of the grid (c1, c2, share, seed): trains on that share of the sample, scores on dev."""
    shared = spark.sparkContext.broadcast((train, dev))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = shared.value
        for frame in frames:
            scores = []
            for r in frame.itertuples():
                turn = np.random.default_rng(int(r.seed)).permutation(len(known))[: int(len(known) * r.share)]
                model = fit([known[k] for k in turn], features, r.c1, r.c2)
                scores.append((len(turn), flat_f1([y for _, y in held], [model.tag(w) for w, _ in held])))
            yield frame.assign(n=[n for n, _ in scores], f1=[f for _, f in scores])

    rows = spark.createDataFrame(grid).repartition(max(1, len(grid)), "trial")
    return rows.mapInPandas(run, "trial long, c1 double, c2 double, share double, seed long, n long, f1 double")


def search(spark: SparkSession, train: list, dev: list, candidates: int = 20, features: str = "wide", seed: int = 42) -> DataFrame:
    """(trial, c1, c2, .., f1): penalties drawn log-uniformly from 1e-4 to 10, scored on the given dev sentences."""
    c = 10 ** np.random.default_rng(seed).uniform(-4, 1, (candidates, 2))
    grid = pd.DataFrame({"trial": range(candidates), "c1": c[:, 0], "c2": c[:, 1], "share": 1.0, "seed": seed})
    return _trials(spark, grid, train, dev, features)


def learning_curve(spark: SparkSession, train: list, dev: list, shares: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), seeds: tuple[int, ...] = (42, 43, 44), features: str = "wide") -> DataFrame:
    """(trial, share, seed, n, f1): the score by size of the training sample."""
    cells = [(share, seed) for share in shares for seed in seeds]
    grid = pd.DataFrame({"trial": range(len(cells)), "c1": 0.1, "c2": 0.1, "share": [x for x, _ in cells], "seed": [y for _, y in cells]})
    return _trials(spark, grid, train, dev, features)


def tagger(labelled: DataFrame, n: int = 5000, features: str = "wide", seed: int = 42) -> Model:
    """A model from tokens with sent_id and label."""
    return fit(sampled(sentences(labelled), n, seed), features, seed=seed)


_BOUND = re.compile(r"[.!?\n](?:(?<=\n)|[\t-\r ])[\t-\r ]*")


def drawn(docs: DataFrame, id_col: str, spans_col: str, n: int = 5000, seed: int = 42, longest: int = 500, text_col: str = "text") -> list[tuple[list[str], list[str]]]:
    """What sampled() draws from the sentences of tokens.labelled(): each task keeps the first by hash, and only sentences that may be drawn are cut into words."""
    kind = dict(docs.dtypes)[id_col]
    spans = F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["tag"].alias("tag")))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("t"), spans.alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(tok.PLAIN_WORDS).finditer
        most = {True: n // 2, False: n}
        held: dict[bool, list[tuple]] = {True: [], False: []}
        bound = {True: "g", False: "g"}  # behind all hashes
        kinds = None

        def trim(rare: bool) -> None:
            held[rare] = sorted(held[rare], key=itemgetter(0))[: most[rare]]
            if len(held[rare]) == most[rare]:
                bound[rare] = held[rare][-1][0] if held[rare] else ""

        for b in batches:
            kinds = b.column(0).type
            for k, (doc, name, text, found) in enumerate(zip(*b.columns, strict=True)):  # noqa: B007
                text, found = text.as_py() or "", found.as_py()
                ends = [m.end() for m in _BOUND.finditer(text)]
                places = [0, *ends, len(text)] if not ends or ends[-1] < len(text) else [0, *ends]
                tags = None
                head = "|".join(x for x in (str(seed), name.as_py()) if x is not None) + "|"
                for number, (a, z) in enumerate(pairwise(places)):
                    h = md5(f"{head}{number}".encode()).hexdigest()
                    if h > bound[False] and (not found or h > bound[True]):
                        continue
                    words = [(m.start() + a, m.end() + a, m[0]) for m in find(text[a:z])]
                    if not 0 < len(words) <= longest:
                        continue
                    labels = ["O"] * len(words)
                    if found:
                        if tags is None:
                            at = [(m.start(), m.end()) for m in re.finditer(tok.PLAIN, text)]
                            given = tok.labels_of(found, {x: i for i, (x, _) in enumerate(at)}, {y: i for i, (_, y) in enumerate(at)}, len(at))
                            tags = {x: label for (x, _), label in zip(at, given, strict=True)}
                        labels = [tags[w[0]] for w in words]
                    rare = any(x != "O" for x in labels)
                    if h <= bound[rare]:
                        held[rare].append((h, rare, doc.as_py(), number, [w for *_, w in words], labels))
                        if len(held[rare]) > 2 * most[rare] + 1000:
                            trim(rare)
        for rare in held:
            trim(rare)
        out = held[True] + held[False]
        if kinds is not None:
            types = [pa.string(), pa.bool_(), kinds, pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["h", "rare", "doc", "sent_id", "words", "labels"])

    some = rows.mapInArrow(run, f"h string, rare boolean, doc {kind}, sent_id int, words array<string>, labels array<string>").persist()
    first = lambda part, k: part.orderBy("h", "doc", "sent_id").limit(k).collect()
    rare = first(some.where("rare"), n // 2)
    out = [(list(r.words), list(r.labels)) for r in rare + first(some.where("not rare"), n - len(rare))]
    some.unpersist()
    return out


def annotate(docs: DataFrame, id_col: str, model: Model, language: str = "plain", text_col: str = "text") -> DataFrame:
    """(doc, ann_id, start, end, tag): documents through tokens, sentences, labels and their repair to spans. No shuffle; sentences are tagged many at a time."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(tok.PATTERNS[language]).finditer
        for b in batches:
            rows, out, held, total = [], [], [], 0

            def settle(rows=rows, out=out, held=held) -> None:
                labels = iter(shared.value.tag_all([words for *_, parts in held for words in parts]))
                for row, words, parts in held:
                    found = _spans_of(words, [x for _ in parts for x in next(labels)])
                    rows += [row] * len(found)
                    out += [(f"T{i}", *span) for i, span in enumerate(found)]
                held.clear()

            for row, text in enumerate(b.column(1)):
                tokens = [(m.start(), m.end(), m[0]) for m in find(text.as_py() or "")]
                words, parts, was = [], [], None
                for t, number in zip(tokens, tok.sentence_numbers([t[2] for t in tokens]), strict=True):
                    if t[2][0] in tok._BLANK:
                        continue
                    if number != was:
                        parts.append([])
                        was = number
                    parts[-1].append(t[2])
                    words.append(t)
                held.append((row, words, parts))
                total += len(words)
                if total > 1 << 17:
                    settle()
                    total = 0
            settle()
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc", "ann_id", "start", "end", "tag"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t")).mapInArrow(run, f"doc {kind}, ann_id string, start int, end int, tag string")


def _spans_of(words: list[tuple[int, int, str]], labels: list[str]) -> list[tuple[int, int, str]]:
    """(start, end, tag) of labelled words, which stand next to each other without the white space; an I that continues nothing opens a span."""
    out: list[list] = []
    before = "O"
    for (start, end, _), label in zip(words, labels, strict=True):
        if label.startswith("B-") or (label != "O" and (before == "O" or before[2:] != label[2:])):
            out.append([start, end, label[2:]])
        elif label != "O":
            out[-1][1] = end
        before = label
    return [tuple(x) for x in out]
