"""Groups of spelling variants, by forward and backward minimal acyclic automata."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import drop_written, text_of, written

LETTERS = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST, TYPO = 5, 3, 97
#: Entries that one automaton holds, about.
ENTRIES = 50_000


class Automaton:
    """A minimal acyclic automaton of sorted distinct words, whose n-th word has the number n.

    Words go in one by one; the part of the last word that the next one leaves is final, and
    is replaced by an equal state if there is one. Each arc knows how many words come before
    those behind it, so that the sum along a word's path is its number.
    """

    def __init__(self, words):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.ends: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[str, dict[str, int]]] = [("", {})]  # the last word's states: letter to it, arcs
        ends = [False]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                letter, arcs = path.pop()
                path[-1][1][letter] = self._state(ends.pop(), arcs, known)

        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            for letter in word[same:]:
                path.append((letter, {}))
                ends.append(False)
            ends[-1] = True
            last = word
        close(0)
        self.start = self._state(ends[0], path[0][1], known)

    def _state(self, end: bool, arcs: dict[str, int], known: dict[tuple, int]) -> int:
        key = (end, *arcs.items())
        at = known.get(key)
        if at is None:
            at = known[key] = len(self.arcs)
            before, out = int(end), {}
            for letter, to in arcs.items():
                out[letter] = to, before
                before += self.size[to]
            self.arcs.append(out)
            self.ends.append(end)
            self.size.append(before)
        return at

    def one_error(self, exact: str, rest: str) -> set[int]:
        """Numbers of the words that begin with exact and go on with rest but for one letter that
        is put in, left out or replaced. Linear in rest for long words too: how a tail of rest
        ends from a state is looked up once."""
        state, number = self.start, 0
        for letter in exact:
            step = self.arcs[state].get(letter)
            if step is None:
                return set()
            state, number = step[0], number + step[1]
        found: set[int] = set()
        known: dict[tuple[int, int], int] = {}

        def complete(state: int, number: int, at: int) -> None:
            """Go on with rest[at:]."""
            trail = []
            while (value := known.get((state, at))) is None:
                if at == len(rest):
                    value = known[state, at] = 0 if self.ends[state] else -1
                    break
                step = self.arcs[state].get(rest[at])
                if step is None:
                    value = known[state, at] = -1
                    break
                trail.append((state, at, step[1]))
                state, at = step[0], at + 1
            for state, at, before in reversed(trail):
                value = known[state, at] = -1 if value < 0 else value + before
            if value >= 0:
                found.add(number + value)

        for at in range(len(rest) + 1):
            letter = rest[at] if at < len(rest) else None
            for other, (to, before) in self.arcs[state].items():
                complete(to, number + before, at)
                if letter is not None and other != letter:
                    complete(to, number + before, at + 1)
            if letter is None:
                break
            complete(state, number, at + 1)
            step = self.arcs[state].get(letter)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", typo: int = TYPO, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n of the words of at least `shortest` letters that occur at least `fewest` times.

    Runs of letters are lower-cased (A-Z only); one whose checksum with its document's id
    `typo` divides loses a letter. Null texts have no words, a null id counts as no characters.
    """
    lowered = F.translate(text_of(docs), UPPER, LOWER)
    runs = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.filter(F.char_length("run") >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), place), F.substring(F.col("run"), place + 2, F.char_length("run")))
    words = runs.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= fewest)


def _entries(words: DataFrame) -> DataFrame:
    """side, exact, rest, asks, word, n: what is looked up, and what can be found.

    A word asks on both sides: with its first half exact (side 0), and backward with its
    second half exact (side 1). It is found by words of its length and of one letter more or
    less, so it is an entry beneath each half that such a word would match exactly.
    """
    size = F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), w.alias("w")) for s, w in enumerate((F.col("word"), F.reverse("word")))])
    both = words.select("word", "n", size.alias("size"), F.explode(sides).alias("s")).select("word", "n", "size", "s.side", "s.w")
    exact = lambda n: F.when(F.col("side") == 0, half(n)).otherwise(n - half(n)).cast("int")
    n = F.col("size")
    cuts = F.array_distinct(F.array(exact(n), exact(n - 1), exact(n + 1)))
    kinds = F.array_union(F.array(F.struct(exact(n).alias("cut"), F.lit(True).alias("asks"))), F.transform(cuts, lambda c: F.struct(c.alias("cut"), F.lit(False).alias("asks"))))
    rows = both.select("side", "word", "n", "w", F.explode(kinds).alias("k"))
    return rows.select("side", F.substring(F.col("w"), F.lit(1), F.col("k.cut")).alias("exact"), F.substring(F.col("w"), F.col("k.cut") + 1, F.char_length("w")).alias("rest"), "k.asks", "word", "n")


def _search(batches):
    """Near words of those that ask. Rows come sorted, what can be found before what asks, a group
    (side, exact, part) after the other; groups share an automaton up to about ENTRIES entries."""

    def answer(entries, asking):
        if not asking:
            return
        auto = Automaton([e[0] for e in entries])
        out = []
        for side, exact, rest, word in asking:
            near, best = 0, None
            for at in auto.one_error(exact, rest):
                _, other, n = entries[at]
                # What both sides find is counted on the first.
                if side and other[: len(word) // 2] == word[: len(word) // 2]:
                    continue
                near += 1
                if best is None or (-n, other) < best:
                    best = -n, other
            if near:
                out.append((word, near, -best[0], best[1]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])

    group, entries, asking = None, [], []
    for batch in batches:
        for side, exact, part, asks, rest, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (side, exact, part) != group:
                if len(entries) >= ENTRIES or group is not None and group[0] != side:
                    yield from answer(entries, asking)
                    entries, asking = [], []
                group = side, exact, part
                # The half that is matched exactly ends in a mark of its part, so that no other group's
                # entries can be reached; marks keep the order of the entries.
                key = exact + _mark(part)
            if not asks:
                entries.append((key + rest, word, n))
            else:
                asking.append((side, key, rest, word))
                if len(asking) >= ENTRIES:  # a group that asks much
                    yield from answer(entries, asking)
                    asking = []
    yield from answer(entries, asking)


def _mark(part: int) -> str:
    """The part of a group as characters below all letters, as many for each part."""
    return "".join(chr(1 + (part >> s & 7)) for s in (18, 15, 12, 9, 6, 3, 0))


def near_words(words: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """word, n_near, form, form_n of each word of (word, n) that has near words: how many differ
    from it by one letter, and the one with the largest n (the smallest of equal n).

    Words are shuffled to the halves that they match exactly. A group of more than `entries`
    words is parted by a hash of the words to be found, and asked in each part.
    """
    rows = _entries(words)
    large = rows.filter(~F.col("asks")).groupBy("side", "exact").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > entries)
    rows = rows.join(large, ["side", "exact"], "left")
    parts = F.coalesce(F.ceil(F.col("m") / entries), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    rows = rows.select("side", "exact", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))).alias("part"), "asks", "rest", "word", "n")
    dealt = rows.repartition("side", "exact", "part").sortWithinPartitions("side", "exact", "part", "asks", "rest")
    found = dealt.mapInArrow(_search, "word string, n_near bigint, form_n bigint, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct (word, n).

    The form is the near word of largest n if that is at least `times` the word's n (2 or
    more), else null. The root is where following forms ends: each step at least doubles n,
    and each round of joins follows twice as many steps as the one before.
    """
    if times < 2:
        raise ValueError("forms of less than twice the n may lead in circles")
    words = words.select("word", F.col("n").cast("long").alias("n"))
    near = words.join(near_words(words), "word", "left")
    kept = F.col("form_n") >= times * F.col("n")
    groups = written(near.select("word", F.when(kept, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(kept, F.col("form_n")).alias("form_n")), "forms")
    links = written(groups.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop_written(links)
        links = new
        if links.filter("moved").isEmpty():
            break
    return groups.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_table(docs: DataFrame) -> DataFrame:
    """spelling_groups() of the words of whole documents."""
    words = written(word_counts(docs), "words")
    return spelling_groups(words)
