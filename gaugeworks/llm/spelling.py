"""Spelling variants: pairs of words one edit apart, by composing finite-state machines.

The vocabulary is a minimal deterministic acceptor A, and E is a transducer that lets a word through
with exactly one letter inserted, deleted or replaced. The accepted paths of A o E o A are the pairs. Until
the edit both copies of A are in one state, so only the states that words reach are visited; after it
both read the same letters, and where they reach one and the same state all words from there on agree
in one step. Arcs carry how many words come before them, so a path is a word's number, not a string.

Partitions are initial states. Of two words one edit apart, with the shorter of length m, either the first
ceil(m / 2) or the last floor(m / 2) letters agree, so a word enters the machines of its first and of its last
letters (those reversed) in the cells of its own length and the next shorter one. A machine of more
than ``LARGEST`` words starts one halving further on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import arrow_batches, ascii_lower, prepare, written

LETTERS = "A-Za-zÀ-ÿ"
LARGEST = 20_000


class Acceptor:
    """The minimal acceptor of sorted distinct words: per state, arcs by letter with (next state, words before the arc)."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []  # words accepted from a state on
        self.span: list[tuple[int, int]] = []  # the least and the greatest number of letters to an end
        self.shared: dict[tuple[int, int], list] = {}  # what pairs of different states have in common
        register: dict[tuple, int] = {}
        path: list[tuple[list, bool]] = [([], False)]  # open states from the start on: arcs so far, final

        def close(depth: int, last: str) -> None:
            """States below ``depth`` get no more arcs: each becomes an equal known state or a new one."""
            while len(path) > depth + 1:
                arcs, final = path.pop()
                path[-1][0].append((last[len(path) - 1], self._state(tuple(arcs), final, register)))

        last = ""
        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            close(shared, last)
            path.extend(([], False) for _ in range(len(word) - shared))
            path[-1] = (path[-1][0], True)
            last = word
        close(0, last)
        self.start = self._state(tuple(path[0][0]), path[0][1], register)

    def _state(self, arcs: tuple, final: bool, register: dict) -> int:
        found = register.get((arcs, final))
        if found is None:
            found = register[arcs, final] = len(self.arcs)
            before, placed = int(final), {}
            for letter, to in arcs:
                placed[letter] = (to, before)
                before += self.count[to]
            ends = ([0] if final else []) + [1 + x for _, to in arcs for x in self.span[to]]
            self.arcs.append(placed)
            self.final.append(final)
            self.count.append(before)
            self.span.append((min(ends, default=0), max(ends, default=0)))
        return found

    def common(self, a: int, b: int) -> list[tuple[int, int]]:
        """Numbers, counted from ``a`` and from ``b``, of the words that both states accept."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if x == y or (x, y) in self.shared:
                todo.pop()
                continue
            few, other = (self.arcs[x], self.arcs[y]) if len(self.arcs[x]) <= len(self.arcs[y]) else (self.arcs[y], self.arcs[x])
            steps = [(*self.arcs[x][c], *self.arcs[y][c]) for c in few if c in other]
            steps = [s for s in steps if self.span[s[0]][0] <= self.span[s[2]][1] and self.span[s[2]][0] <= self.span[s[0]][1]]
            first = [(to_x, to_y) for to_x, _, to_y, _ in steps if to_x != to_y and (to_x, to_y) not in self.shared]
            if first:
                todo.extend(first)
                continue
            found = [(0, 0)] if self.final[x] and self.final[y] else []
            for to_x, at_x, to_y, at_y in steps:
                found += ((at_x + i, at_y + j) for i, j in self._known(to_x, to_y))
            self.shared[x, y] = found
            todo.pop()
        return self._known(a, b)

    def _known(self, a: int, b: int) -> list[tuple[int, int]]:
        return [(k, k) for k in range(self.count[a])] if a == b else self.shared[a, b]

    def edited_here(self, state: int) -> set[tuple[int, int]]:
        """Pairs of words from ``state`` on whose one edit is the next letter: smaller and larger number."""
        found, arcs = set(), list(self.arcs[state].values())
        for k, (to, at) in enumerate(arcs):
            pairs = [(at + i, j) for i, j in self.common(to, state)]  # a letter more than the other word
            for other, there in arcs[:k]:
                pairs += ((at + i, there + j) for i, j in self.common(to, other))  # another letter
            found.update((min(p), max(p)) for p in pairs)
        return found

    def near(self) -> set[tuple[int, int]]:
        """Numbers of all pairs of accepted words that are one edit apart."""
        known: dict[int, set] = {}
        found, todo = set(), [(self.start, 0)]
        while todo:
            state, base = todo.pop()
            if self.count[state] < 2:
                continue  # one word alone has no partner here
            if state not in known:
                known[state] = self.edited_here(state)
            found.update((base + i, base + j) for i, j in known[state])
            todo.extend((to, base + at) for to, at in self.arcs[state].values())
        return found


def near_pairs(words: list[str], backward: bool) -> list[tuple[int, int]]:
    """Positions of the pairs of distinct ``words`` one edit apart; ``backward`` reads them from the end."""
    read = [w[::-1] for w in words] if backward else words
    order = sorted(range(len(words)), key=read.__getitem__)
    return [(order[i], order[j]) for i, j in Acceptor([read[k] for k in order]).near()]


def occurring_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 7, least: int = 2, noise: int = 31) -> DataFrame:
    """``word`` and ``n`` (occurrences), of words with enough letters and occurrences.

    A word is a maximal run of letters, A-Z lower-cased. Of every ``noise``-th, by a checksum of its id and
    itself, one letter is deleted. A null id counts as an empty one, a null text has no words.
    """
    # shorter runs never make a long enough word; a longer run is matched whole
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    run = docs.select(ident.alias("id"), F.explode(runs).alias("run")).select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    without = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod("h", F.lit(noise)) == 0, without).otherwise(F.col("run"))
    counted = run.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= least_letters)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _halves(rest: Column, m: Column) -> tuple[Column, Column]:
    """Both ends of a remainder whose shorter form has ``m`` letters: one of them is free of the edit."""
    first, last = F.ceil(m / 2).cast("int"), F.floor(m / 2).cast("int")
    return F.substring(rest, F.lit(1), first), F.substring(rest, F.char_length(rest) - last + 1, last)


def cells(words: DataFrame, largest: int) -> DataFrame:
    """``backward``, ``m`` (letters of the shorter word of a pair), ``key`` (the initial state) and its ``held`` words.

    A cell has words of ``m`` and ``m + 1`` letters. Cells with more than ``largest`` words are cut once more.
    """
    length = F.char_length("word")
    placed = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    ends = placed.select("*", *(c.alias(name) for c, name in zip(_halves(F.col("word"), F.col("m")), ("head", "tail"))))
    each = F.array(F.struct(F.lit(False).alias("backward"), F.col("head").alias("key")), F.struct(F.lit(True).alias("backward"), F.col("tail").alias("key")))
    keyed = written(ends.select("word", "n", "m", F.explode(each).alias("at")).select("word", "n", "m", "at.*"), "word-cells")
    cell = ["backward", "m", "key"]
    sizes = keyed.groupBy(*cell).agg(F.count("*").alias("size")).where("size > 1")
    sized = keyed.join(sizes.withColumn("large", F.col("size") > largest).drop("size"), cell)
    fixed = F.char_length("key")
    rest = F.when(F.col("backward"), F.substring("word", F.lit(1), F.char_length("word") - fixed)).otherwise(F.substring("word", fixed + 1, F.char_length("word")))
    cut = sized.withColumn("rest", rest)
    one, two = _halves(F.col("rest"), F.col("m") - F.char_length("key"))
    finer = F.array(*(F.struct(F.lit(end).alias("end"), k.alias("part")) for end, k in ((0, one), (1, two))))
    whole = F.array(F.struct(F.lit(2).alias("end"), F.lit("").alias("part")))
    dealt = cut.select("word", "n", *cell, F.explode(F.when(F.col("large"), finer).otherwise(whole)).alias("at")).select("word", "n", *cell, "at.*")
    held = dealt.groupBy(*cell, "end", "part").agg(F.collect_list(F.struct("word", "n")).alias("held"))
    return held.where(F.size("held") > 1).select("backward", "m", "held")


def near_words(words: DataFrame, *, largest: int = LARGEST) -> DataFrame:
    """Pairs of distinct ``words`` (``word``, ``n``) one edit apart: ``a``, ``a_n``, ``b``, ``b_n``, each pair once."""

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            rows = []
            for backward, held in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for i, j in near_pairs([h["word"] for h in held], backward):
                    a, b = sorted((held[i], held[j]), key=lambda h: h["word"])
                    rows.append((a["word"], a["n"], b["word"], b["n"]))
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["a", "a_n", "b", "b_n"])

    return cells(words, largest).mapInArrow(compose, "a string, a_n long, b string, b_n long").distinct()


def variants(docs: DataFrame, *, largest: int = LARGEST, dominance: int = 10, **options) -> DataFrame:
    """Per word of ``docs``: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    Words are those of ``occurring_words`` (its options apply). A word's form is its near word (one letter
    inserted, deleted or replaced) of largest ``n``, ties by smallest word, if that has at least ``dominance``
    times the word's own ``n``. ``root`` follows forms to the last one; without a form it is the word itself.

    Each step to a form multiplies ``n``, so chains are short, and following them takes a few joins. Repeated
    rows and repeated ids count as often as they stand there. Columns other than id and text don't matter.
    Words of any length are whole. An empty table gives an empty result.
    """
    if dominance < 2:
        raise ValueError("a form has at least twice its word's occurrences")
    prepare(docs.sparkSession)
    words = written(occurring_words(docs, **options), "words")
    pairs = near_words(words, largest=largest)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    chosen = F.col("best.minus") <= -dominance * F.col("n")
    formed = written(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(chosen, F.col("best.near")).alias("form"),
            F.when(chosen, -F.col("best.minus")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        # every step doubles how far a word has followed its forms
        known = written(roots, "word-roots")
        further = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = known.join(further, "root", "left")
        if stepped.where(F.col("next").isNotNull()).isEmpty():
            break
        roots = stepped.select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
