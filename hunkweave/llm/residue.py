"""Template residue, filler, error pages and script notices in place of real text.

Labelled exemplars are indexed by their rarest words and signs. A text is cut into tokens, tokens of the index name the
exemplars to try, and a passage window around such a token is a match when it contains nearly all of an exemplar, weighed by
how rare each token is in the corpus (TF-IDF containment). An exact check of the form follows for marks left to fill in.

Filler has no wording. Its exemplars are openings: the letter triples of the passages that the openings retrieve from the
corpus, as far as they are much more frequent there than elsewhere, are the exemplar, and a window of words is a match when its
own letter triples, weighed by their rarity in the corpus, are nearly all contained in it. A passage that says the same few
words over and over is its own exemplar: each window is contained in the one before.

Text in code, in quotation marks within a sentence and in log lines is shown, not meant, and is left out beforehand.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkweave.llm.exemplars import EXEMPLARS

Exemplars = list[tuple[str, str, str]]

_NAME = r"[A-Za-z]+(?:[_.][A-Za-z]+)*"
_CJK = r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff々〇]"
SIGNS = frozenset(("<!--", "-->", "{{", "}}", "${", "#{", "<%", "<%=", "%>", "[[", "]]", "@@", "__", "%(", *"[]<>(){}【】〈〉*#$%"))
_SIGN = r"<!--|-->|\{\{|\}\}|[$#]\{|<%=?|%>|\[\[|\]\]|@@|__|%\(|[\[\]<>(){}【】〈〉*#$%]"
TOKEN = re.compile(rf"([^\W\d_\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+(?:['’][^\W\d_]+)*)|(\d+(?:[.,:]\d+)*)|({_CJK}+)|{_SIGN}")
PLAIN = re.compile(r"[a-z]+(?:'[a-z]+)*")
LETTERS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
HAS_CJK = re.compile(_CJK)
NUMBER = re.compile(r"[0-9]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_FENCE = re.compile(r"```[^\n`]*\n.*?\n[ >+*#/-]*```", re.S)
_INLINE = re.compile(r"`[^`\n]+`")
_QUOTED = re.compile(r"(?<=[^\W\d_] )(?:\"[^\"\n]{2,}\"|“[^”\n]{2,}”|«[^»\n]{2,}»)|„[^“\n]{2,}“|「[^」\n]{2,}」|『[^』\n]{2,}』")
_LOGGED = re.compile(r"^[ \t>+*#/-]*\d\d:\d\d:\d\d[.,]\d+ .*$", re.M)
_CODE = re.compile(r"^[+\- >*/]*(?:const |let |var |if \(|for \(|return |log\(|import |export |function ).*$", re.M)

SCRIPTS = dict.fromkeys(["js", "javascript", "script", "scripts", "scripting", "skript", "skripte", "skripten"], "script")

# Letter triples: a–z as 1 to 26, everything else as the 0 between words.
TRIPLES = 27**3
_LETTER = np.zeros(256, np.int32)
for _i in range(26):
    _LETTER[97 + _i] = _LETTER[65 + _i] = _i + 1


def triples(text: str) -> np.ndarray:
    """Numbers of the letter triples of all words, word ends included; other letters than a to z count as word ends."""
    m = _LETTER[np.frombuffer(f" {text} ".encode("ascii", "replace"), np.uint8)]
    a, b, c = m[:-2], m[1:-1], m[2:]
    return (a * 729 + b * 27 + c)[(b > 0) & ((a > 0) | (c > 0))]


def shown_only(text: str) -> str:
    """The text with quoted, logged and code passages blanked out; offsets stay."""
    for pattern in (_FENCE, _INLINE, _QUOTED, _LOGGED, _CODE):
        text = pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    return text


def tokens(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end): words in lower case, numbers as ``0``, signs, and character pairs of Chinese and Japanese."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        kind = m.lastindex
        if kind == 1:
            word = m.group().lower()
            out.append((SCRIPTS.get(word, word) if "’" not in word else word.replace("’", "'"), a, b))
        elif kind == 2:
            out.append(("0", a, b))
        elif kind is None:
            out.append((m.group(), a, b))
        elif b - a == 1:
            out.append((m.group(), a, b))
        else:
            word = m.group()
            out.extend((word[i : i + 2], a + i, a + i + 2) for i in range(len(word) - 1))
    return out


def token_list(text: str) -> list[str]:
    """Words of a text in order, without offsets; texts without Chinese or Japanese take a fast way that leaves numbers and signs to ``signs``."""
    if text.isascii():
        words = PLAIN.findall(text.lower())
    elif not HAS_CJK.search(text):
        words = LETTERS.findall(text.lower().replace("’", "'"))
    else:
        return [t for t, _, _ in tokens(text)]
    return words if SCRIPTS.keys().isdisjoint(words) else [SCRIPTS.get(w, w) for w in words]


def exemplar_tokens(text: str) -> list[str]:
    """Tokens of an exemplar without its gaps; ``#`` alone is a number."""
    return [("0" if t == "#" else t) for t, _, _ in tokens(text.replace("*", " "))]


def is_sign(token: str) -> bool:
    return token in SIGNS


def signs(text: str, wanted: list[str]) -> set[str]:
    """The tokens of a text that are no words, of those wanted."""
    found = {c for c in wanted if c in text}
    if NUMBER.search(text):
        found.add("0")
    return found


def _form(text: str) -> re.Pattern:
    """The exact form of a mark. White space is free. A gap is any words without brackets, in a mark of signs alone a name.

    A mark that opens with a single sign, or with signs that may belong to a word, must not touch other letters or such signs.
    """
    if re.search(r"[^\W\d_]{2}", text):
        gap = r"\s*[^\s\[\]<>(){}【】〈〉]+(?:[^\S\n]+[^\s\[\]<>(){}【】〈〉]+)*?\s*"
        return re.compile(gap.join(r"\s*".join(re.escape(w) for w in p.split()) for p in text.split("*")), re.I)
    before, after = text.split("*")
    body = re.escape(before.rstrip()) + (r"\s*" if before.endswith(" ") else "") + _NAME + (r"\s*" if after.startswith(" ") else "") + re.escape(after.lstrip())
    if len(before.strip()) == 1 or before.strip() == "__":
        body = rf"(?<![\w$#%{{]){body}(?![\w{re.escape(after.strip()[-1])}])"
    return re.compile(body)


class Profile:
    """The look of filler: letter triples with their weights in the corpus, and which of them belong to filler.

    A triple belongs to filler where its share in the passages retrieved by openings is ``rise`` times that in all other text.
    Filler of made-up words that has no opening itself is thus found as far as the corpus holds some like it that has one.
    """

    def __init__(self, everywhere: np.ndarray, retrieved: np.ndarray, exemplar: np.ndarray, rise: float = 3.0) -> None:
        self.weights = np.log((everywhere.sum() + 1) / (everywhere + 0.5))
        filler, rest = retrieved + exemplar, np.maximum(everywhere - retrieved, 0)
        self.member = (filler > 0) & (filler / max(1, filler.sum()) >= rise * (rest + 1) / max(1, rest.sum()))
        self.known: dict[str, tuple[float, float]] = {}
        self.met: set[str] = set()
        self.whole_words: set[str] = set()

    def any_contained(self, words: set[str], containment: float) -> bool:
        """True where one of the words on its own is contained in filler."""
        fresh = words - self.met
        if fresh:
            if len(self.met) > 500_000:
                self.met.clear()
                self.whole_words.clear()
                fresh = words
            self.met |= fresh
            self.whole_words.update(w for w in fresh if self.share(w) >= containment)
        return not self.whole_words.isdisjoint(words)

    def share(self, word: str) -> float:
        got, whole = self.score(word)
        return got / whole

    def score(self, word: str) -> tuple[float, float]:
        """(contained, whole) weight of a word; what has no triples, as single or other letters, weighs as three rare ones and is not contained."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            t = triples(word) if word.isascii() and word[0].isalpha() else _LETTER[:0]
            if len(t):
                got = float((self.weights[t] * self.member[t]).sum()), float(self.weights[t].sum())
            else:
                got = 0.0, 3 * float(self.weights.max())
            self.known[word] = got
        return got


class Openings:
    """Finds where filler begins: two words in a row as in a style exemplar, or two runs along a row of the keyboard."""

    def __init__(self, exemplars: Exemplars) -> None:
        texts = [t for _, form, t in exemplars if form == "style"]
        self.rows = [w for t in texts for w in t.split() if len(w) >= 7 and len(t.split()) <= 4]
        self.pairs = {p for t in texts if len(t.split()) > 4 for p in zip(t.split(), t.split()[1:])}
        self.own = sum((np.bincount(triples(t), minlength=TRIPLES) for t in texts), np.zeros(TRIPLES, np.int64))
        self.first = {a for a, _ in self.pairs}
        self.runs = {row[i:j] for row in self.rows for i in range(len(row)) for j in range(i + 3, len(row) + 1)}

    def passages(self, words: list[str], reach: int = 40) -> list[str]:
        """The words after each opening, at most ``reach`` of them, joined."""
        out, last = [], -1
        if self.pairs.isdisjoint(zip(words, words[1:])) and self.runs.isdisjoint(words):
            return out
        for i, (a, b) in enumerate(zip(words, words[1:])):
            if i >= last and ((a in self.first and (a, b) in self.pairs) or (a in self.runs and b in self.runs)):
                out.append(" ".join(words[i : i + 2 + reach]))
                last = i + 2 + reach
        return out


class Index:
    """Inverted index of the exemplars under token weights from the corpus."""

    def __init__(self, exemplars: Exemplars, weights: dict[str, float], default: float, profile: Profile, containment: float) -> None:
        self.containment, self.profile = containment, profile
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.entries = []
        for label, form, text in exemplars:
            words = exemplar_tokens(text)
            if form == "style" or not words:
                continue
            weighed = Counter(words)
            total = sum(weights.get(w, default) * n for w, n in weighed.items())
            number = len(self.entries)
            self.entries.append((label, form, words, weighed, total, _form(text) if form == "mark" else None, 2 + 3 * text.count("*")))
            order = sorted(range(len(words)), key=lambda i: (-weights.get(words[i], default), i))
            # A window without the tokens indexed here weighs too little to match, so nothing is missed.
            indexed, enough = 0.0, (1 - containment) * total if form == "passage" else 0.0
            for i in order:
                self.postings.setdefault(words[i], []).append((number, i))
                indexed += weights.get(words[i], default)
                if indexed > enough:
                    break
        self.weight = lambda w: weights.get(w, default)
        # Looks that leave out texts in which nothing can match: marks of signs by their form, all else by the tokens indexed.
        bare = {n for n, e in enumerate(self.entries) if e[1] == "mark" and all(is_sign(w) or len(w) == 1 for w in e[2])}
        self.signed = [(self.entries[n][2][0], self.entries[n][5]) for n in sorted(bare)]
        self.sign_keys = [k for k, p in self.postings.items() if is_sign(k) and any(n not in bare for n, _ in p)]
        self.words = {k for k, p in self.postings.items() if not is_sign(k) and k != "0" and any(n not in bare for n, _ in p)}

    def may_match(self, text: str) -> bool:
        """False where one look at the text's words and signs shows that nothing in it can match."""
        quick = token_list(text)
        distinct = set(quick)
        if not self.words.isdisjoint(distinct) or any(k in text for k in self.sign_keys):
            return True
        if any(k in text and form.search(text) for k, form in self.signed):
            return True
        return self._filler_near(quick, distinct)

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(label, start, end, score) of the residue in one text."""
        if not self.may_match(text):
            return []
        clear = shown_only(text)
        words = tokens(clear)
        found = []
        tried = set()
        bags: dict[int, tuple[Counter, int, int]] = {}
        breaks = [m.end() for m in _BLANK_LINE.finditer(clear)] + [len(clear) + 1]
        part = 0
        for p, (word, a, b) in enumerate(words):
            while a >= breaks[part]:
                part += 1
            for number, at in self.postings.get(word, ()):
                label, form, needed, weighed, total, exact, slack = self.entries[number]
                if form == "passage":
                    key = (number, p - at)
                    if key in tried:
                        continue
                    tried.add(key)
                    first, last = max(0, p - at - slack), min(len(words), p - at + len(needed) + slack)
                    score = self._contained(weighed, total, Counter(w for w, _, _ in words[first:last]))
                    if score >= self.containment:
                        found.append((label, words[first][1], words[last - 1][2], score))
                elif form == "mark":
                    if (number, -1 - part) in tried:
                        continue
                    tried.add((number, -1 - part))
                    start, end = breaks[part - 1] if part else 0, min(breaks[part], len(clear))
                    if part not in bags:
                        bags[part] = self._bag(words, p, start, end)
                    score = self._contained(weighed, total, bags[part])
                    if score >= self.containment:
                        found.extend((label, m.start(), m.end(), score) for m in exact.finditer(clear, start, end))
                else:
                    found.extend(self._line(label, weighed, total, clear, words, p))
        return list(dict.fromkeys(found)) + self._covered(words)

    def _contained(self, weighed: Counter, total: float, have: Counter) -> float:
        return sum(self.weight(w) * min(n, have[w]) for w, n in weighed.items()) / total

    @staticmethod
    def _bag(words: list[tuple[str, int, int]], p: int, start: int, end: int) -> Counter:
        """The tokens between two offsets, around the token ``p`` that lies between them."""
        lo = hi = p
        while lo and words[lo - 1][1] >= start:
            lo -= 1
        while hi < len(words) and words[hi][2] <= end:
            hi += 1
        return Counter(w for w, _, _ in words[lo:hi])

    def _line(self, label: str, weighed: Counter, total: float, clear: str, words: list[tuple[str, int, int]], p: int) -> list[tuple[str, int, int, float]]:
        """A line contained in an exemplar that is contained in the line; signs that quote, list or end a line do not count."""
        a = clear.rfind("\n", 0, words[p][1]) + 1
        b = clear.find("\n", words[p][2])
        b = len(clear) if b < 0 else b
        near = sum(weighed.values()) + 8
        if (p >= near and words[p - near][1] >= a) or (p + near < len(words) and words[p + near][2] <= b):
            return []  # more words on the line than an exemplar that contains them can have
        have = Counter({w: n for w, n in self._bag(words, p, a, b).items() if not is_sign(w)})
        whole = sum(self.weight(w) * n for w, n in have.items())
        score = min(self._contained(weighed, total, have), sum(self.weight(w) * min(n, weighed[w]) for w, n in have.items()) / whole)
        return [(label, a, b, score)] if score >= self.containment and re.fullmatch(r"[\s#>*-]*[\w ]+[.!:|\s]*", clear[a:b]) else []

    def _filler_near(self, plain: list[str], distinct: set[str], run: int = 12) -> bool:
        if self.profile.any_contained(distinct, self.containment):
            return True  # a window cannot be contained as a whole without a word that is
        if any(w.count(w[0]) == len(w) for w in distinct if len(w) >= 12):
            return True
        half = run // 2  # of every run's places two at this distance are looked at
        for i in range(0, len(plain) - half, half):
            word = plain[i]
            near = plain[i + 1 : i + 9]
            if word in near:
                for p, x in enumerate(near, 1):
                    if x == word and i + half + p < len(plain) and plain[i + half] == plain[i + half + p] and bytes(map(eq, plain, plain[p:])).find(b"\x01" * max(run, 3 * p)) >= 0:
                        return True
        return False

    def _styled(self, scores: list[tuple[float, float]], window: int) -> list[tuple[int, int, float]]:
        """(first, last, score) of the longest stretches of windows whose letter triples are contained in filler; five words at the least."""
        size = min(window, len(scores))
        if size < 5:
            return []
        sums = np.cumsum(np.concatenate([np.zeros((1, 2)), np.asarray(scores)]), axis=0)
        got, whole = (sums[size:] - sums[:-size]).T
        share = got / np.maximum(whole, 1e-9)
        hit = np.flatnonzero(share >= self.containment)
        if not len(hit):
            return []
        stretches = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
        return [(int(s[0]), int(s[-1]) + size - 1, float(share[s].max())) for s in stretches]

    def _covered(self, words: list[tuple[str, int, int]], window: int = 8, run: int = 12) -> list[tuple[str, int, int, float]]:
        """Every longest stretch with the look of filler, and every run of up to eight words (or pairs of signs) over and over."""
        found = []
        plain = [w for w, _, _ in words]
        if self.profile.any_contained(set(plain) - SIGNS, self.containment):
            worded = [x for x in words if x[0] not in SIGNS]
            for first, last, score in self._styled([self.profile.score(w) for w, _, _ in worded], window):
                found.append(("filler", worded[first][1], worded[last][2], score))
        known = bytearray(len(plain))
        for period in range(1, 9):
            least = max(run, 3 * period)
            equal = bytes(map(eq, plain, plain[period:]))
            at = equal.find(b"\x01" * least)
            while at >= 0:
                end = equal.find(b"\x00", at)
                end = len(equal) if end < 0 else end
                # A run of a shorter period is one of its multiples too.
                if all(w.replace("'", "").isalpha() for w in plain[at : at + period]) and not all(known[at : end + period]):
                    known[at : end + period] = b"\x01" * (end + period - at)
                    found.append(("filler", words[at][1], words[end + period - 1][2], 1.0))
                at = equal.find(b"\x01" * least, end)
        for word, a, b in words:
            if b - a >= 12 and word.isascii() and word.isalpha() and len(set(word)) == 1:
                found.append(("filler", a, b, 1.0))
        return found


_built: dict[str, Index] = {}


def corpus_statistics(docs: DataFrame, exemplars: Exemplars, text_col: str = "text") -> tuple[dict[str, float], float, Profile]:
    """Inverse document frequency of every exemplar token over the whole corpus, the weight of a token in no text, and the look of filler.

    Counts are added up on the executors over all texts. What reaches the driver is bounded: the exemplars' own tokens, and
    two counts for each of the 19,683 letter triples.
    """
    vocabulary = {w for _, _, t in exemplars for w in exemplar_tokens(t)}
    wanted = sorted(w for w in vocabulary if is_sign(w))
    openings = Openings(exemplars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = chars = 0
        held: list[str] = []
        everywhere, retrieved = np.zeros(TRIPLES, np.int64), np.zeros(TRIPLES, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                n += 1
                words = token_list(text)
                seen.update(vocabulary.intersection(words) | vocabulary.intersection(signs(text, wanted)))
                held.append(text)
                chars += len(text)
                for passage in openings.passages(words):
                    retrieved += np.bincount(triples(passage), minlength=TRIPLES)
                if chars > 1_000_000:
                    everywhere += np.bincount(triples(" ".join(held)), minlength=TRIPLES)
                    held, chars = [], 0
        everywhere += np.bincount(triples(" ".join(held)), minlength=TRIPLES)
        for kind, values in ((1, everywhere), (2, retrieved)):
            at = np.flatnonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at.astype(str).tolist(), pa.string()), pa.array(values[at], pa.int64())], ["kind", "key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([0] * (len(seen) + 1), pa.int32()), pa.array([*seen, None], pa.string()), pa.array([*seen.values(), n], pa.int64())], ["kind", "key", "n"])

    rows = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull()).mapInArrow(count, "kind int, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in rows if r["key"] is None)
    seen = {r["key"]: math.log((1 + total) / (0.5 + r["n"])) for r in rows if r["kind"] == 0 and r["key"] is not None}
    counts = np.zeros((3, TRIPLES), np.int64)
    for r in rows:
        if r["kind"]:
            counts[r["kind"], int(r["key"])] = r["n"]
    return seen, math.log((1 + total) / 0.5), Profile(counts[1], counts[2], openings.own)


def exemplar_rows(exemplars: DataFrame | Exemplars | None, most: int = 100_000) -> Exemplars:
    """The labelled exemplars as rows (label, form, text); a table of them is read on the driver and must have at most ``most`` rows."""
    if exemplars is None:
        return EXEMPLARS
    if isinstance(exemplars, DataFrame):
        exemplars = [tuple(r) for r in exemplars.select("label", "form", "text").where("text is not null").limit(most + 1).collect()]
    if len(exemplars) > most:
        raise ValueError(f"more than {most} exemplars")
    unknown = {form for _, form, _ in exemplars} - {"mark", "passage", "line", "style"}
    if unknown:
        raise ValueError(f"unknown forms of exemplars: {sorted(unknown)}")
    return list(exemplars)


def residue_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, exemplars: DataFrame | Exemplars | None = None) -> DataFrame:
    """(id, label, start_offset, end_offset, score) of every passage that matches an exemplar.

    ``exemplars``: labelled rows (label, form, text), by default those of ``hunkweave.llm.exemplars``. Null, empty and blank
    texts have no residue. Texts are scanned whole. Offsets are code points. Repeated rows give repeated passages; other
    columns are ignored; an empty table gives an empty result.
    """
    import uuid

    rows = exemplar_rows(exemplars)
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows, *corpus_statistics(docs, rows, text_col)))
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *inputs = shared.value
        if name not in _built:
            _built.clear()
            _built[name] = Index(*inputs, containment)
        index = _built[name]
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                for hit in index.find(text):
                    at.append(i)
                    hits.append(hit)
            label, a, b, score = zip(*hits) if hits else ((), (), (), ())
            ids = batch["id"].take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(label, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], ["id", "label", "start_offset", "end_offset", "score"])

    slim = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").where(F.col("text").isNotNull())
    return slim.mapInArrow(scan, f"id {kind}, label string, start_offset long, end_offset long, score double").withColumnRenamed("id", id_col)


def residue_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, exemplars: DataFrame | Exemplars | None = None) -> DataFrame:
    """(id) of the documents with residue anywhere, each once."""
    return residue_passages(docs, id_col, text_col, containment, exemplars).select(id_col).distinct()


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8, exemplars: DataFrame | Exemplars | None = None) -> DataFrame:
    """The documents that have no residue; a null id cannot be excluded and is kept."""
    return docs.join(residue_documents(docs, id_col, text_col, containment, exemplars), id_col, "left_anti")
