"""JN-18: proposals for a user's memory that say nothing new."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..sources.captures import query_log
from ..sources.scratch import written

RATIO, OVERLAP, LEAST_WORDS = 0.72, 0.7, 3
#: Lines of a user in a task, and those compared at once; tasks of a step, as Spark would put many small blocks into one; classes that letters are counted in, up to so many.
BLOCK, AT_ONCE, TASKS, LETTER_CLASSES, MOST_COUNTED = 4_096, 256, 48, 64, 32_767
# Words that say nothing of a fact.
SMALL_WORDS = ("the", "a", "an", "he", "she", "his", "her", "with", "and", "for", "of", "to", "in", "on", "at", "is", "was", "as", "per", "also")


def fact_words(text: str) -> frozenset[str]:
    """Words of two letters or more without small ones; a plural's s goes from words of four letters or more."""
    words = (w for w in re.findall(r"[a-z0-9/]+", text.lower()) if len(w) > 1 and w not in SMALL_WORDS)
    return frozenset(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in words)


class Fact:
    """A line with what its comparisons need."""

    def __init__(self, text: str):
        self.text = text.lower()
        self.words, self.letters = fact_words(text), Counter(self.text)

    def like(self, other: Fact) -> bool:
        """Whether other, which is known, says the same: by shared words, or by the ratio of their letters in order.

        The ratio is bounded by the lengths and by the letters in any order first, which decides most pairs.
        """
        small = min(len(self.words), len(other.words))
        if small >= LEAST_WORDS and len(self.words & other.words) / small > OVERLAP:
            return True
        n, m = len(self.text), len(other.text)
        if not n + m or 2 * min(n, m) / (n + m) <= RATIO or 2 * sum((self.letters & other.letters).values()) / (n + m) <= RATIO:
            return not n + m
        return SequenceMatcher(None, self.text, other.text).ratio() > RATIO


class Known:
    """The lines of a block: a line goes through the exact comparison with those only that bounds over all lines at once leave.

    Bounds are the lengths, the letters in any order and the longest common subsequence, none of which the ratio's letters can exceed; shared words are counted.
    """

    def __init__(self):
        self.facts: list[Fact] = []
        self.holders: dict[str, list[int]] = {}
        self.n_words = np.zeros(64, np.int64)
        self.lengths, self.letters = np.zeros(64, np.int64), np.zeros((64, LETTER_CLASSES), np.int16)
        self.starts, self.codes, self.end = np.zeros(64, np.int64), np.zeros(4_096, np.int64), 0
        self.code_of: dict[str, int] = {}

    def _coded(self, text: str) -> np.ndarray:
        """Numbers of a text's letters from 1; letters get theirs as they are met."""
        return np.array([self.code_of.setdefault(c, len(self.code_of) + 1) for c in text], np.int64)

    def add(self, fact: Fact) -> None:
        i, codes = len(self.facts), self._coded(fact.text)
        if i == len(self.lengths):
            self.n_words, self.lengths, self.starts, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n_words, self.lengths, self.starts, self.letters))
        if self.end + len(codes) > len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros(len(self.codes) + len(codes), np.int64)])
        self.n_words[i], self.lengths[i], self.starts[i] = len(fact.words), len(codes), self.end
        self.letters[i] = np.minimum(np.bincount(codes % LETTER_CLASSES, minlength=LETTER_CLASSES), MOST_COUNTED)
        self.codes[self.end : self.end + len(codes)] = codes
        self.end += len(codes)
        for w in fact.words:
            self.holders.setdefault(w, []).append(i)
        self.facts.append(fact)

    def near(self, facts: list[Fact]) -> list[list[int]]:
        """For each of some facts the lines that the bounds leave; it can be like no other."""
        n, out = len(self.facts), [[] for _ in facts]
        groups: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        lengths = self.lengths[:n]
        for k, fact in enumerate(facts if n else []):
            shared = Counter(i for w in fact.words for i in self.holders.get(w, ()))
            out[k] += [i for i, c in shared.items() if (small := min(len(fact.words), int(self.n_words[i]))) >= LEAST_WORDS and c / small > OVERLAP]
            codes = self._coded(fact.text)
            both = np.maximum(lengths + len(codes), 1)
            at = np.flatnonzero(2 * np.minimum(lengths, len(codes)) / both > RATIO)
            own = np.minimum(np.bincount(codes % LETTER_CLASSES, minlength=LETTER_CLASSES), MOST_COUNTED).astype(np.int16)
            any_order = np.minimum(self.letters[at], own).sum(axis=1, dtype=np.int32)
            at = at[(2 * any_order / both[at] > RATIO) | (len(codes) > MOST_COUNTED)]
            if len(at):
                groups.setdefault(-(-len(codes) // 64), []).append((k, codes, at))
        for words, some in groups.items():
            owner, at = np.repeat(np.arange(len(some)), [len(x) for _, _, x in some]), np.concatenate([x for _, _, x in some])
            common = common_letters([c for _, c, _ in some], words, owner, self.codes, self.starts[at], lengths[at], len(self.code_of) + 1)
            own = np.array([len(c) for _, c, _ in some])[owner]
            for o, i in zip(*(x[2 * common / (own + lengths[at]) > RATIO].tolist() for x in (owner, at)), strict=True):
                out[some[o][0]].append(i)
        return out

    def rejected(self, facts: list[Fact]) -> list[bool]:
        """Whether each of some facts is like a line."""
        return [any(fact.like(self.facts[i]) for i in near) for fact, near in zip(facts, self.near(facts), strict=True)]

    def taken(self, facts: list[Fact]) -> list[bool]:
        """Whether each of some facts, in order, is unlike all lines and all taken before it; those taken become lines."""
        new = Known()
        for fact in facts:
            new.add(fact)
        out = [not x for x in self.rejected(facts)]
        for k, near in enumerate(new.near(facts)):
            out[k] = out[k] and not any(i < k and out[i] and facts[k].like(facts[i]) for i in near)
            if out[k]:
                self.add(facts[k])
        return out


def common_letters(owns: list[np.ndarray], words: int, owner: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_codes: int) -> np.ndarray:
    """The length of the longest common subsequence of each pair of a text (owns, of up to words * 64 letters) and a slice of codes, by bits: a step a letter for all pairs at once."""
    has = np.zeros((words, len(owns), n_codes), np.uint64)
    for o, own in enumerate(owns):
        for k, c in enumerate(own.tolist()):
            has[k // 64, o, c] |= np.uint64(1 << (k % 64))
    has = has.reshape(words, -1)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, base = starts[order], lengths[order], owner[order] * n_codes
    free = np.full((words, len(order)), 2**64 - 1, np.uint64)
    for j, m in enumerate(np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left").tolist()):  # the m longest have a letter here
        letter = base[:m] + codes[starts[:m] + j]
        carry = None
        for w in range(words):
            v = free[w, :m]
            met = v & has[w][letter]
            total = v + met
            over = total < v if w + 1 < words else None
            if carry is not None:
                total += carry
                if over is not None:
                    over |= total < carry
            carry = over
            v ^= met  # the letters met are bits of v
            v |= total
    out = np.zeros(len(order), np.int64)
    out[order] = np.bitwise_count(~free).sum(axis=0, dtype=np.int64)
    return out


def judged(df: DataFrame, keys: list[str], fold: bool) -> DataFrame:
    """The new rows of df (keys, is_new, proposal_id, text) that are like an old row of their key; with fold, those that are unlike all old and taken ones, in order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = None, None
        for batch in batches:
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            is_new, texts = batch.column("is_new").to_pylist(), batch.column("text").to_pylist()
            keep, at = [], 0
            while at < len(texts):
                if state is None or own[at] != key:
                    key, state = own[at], Known()
                end = at + 1
                while end < min(len(texts), at + AT_ONCE) and own[end] == key and is_new[end] == is_new[at]:
                    end += 1
                facts = [Fact(t) for t in texts[at:end]]
                if is_new[at]:
                    keep += state.taken(facts) if fold else state.rejected(facts)
                else:
                    for fact in facts:
                        state.add(fact)
                    keep += [False] * len(facts)
                at = end
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.repartition(TASKS, *keys).sortWithinPartitions(*keys, "is_new", "proposal_id", "text").mapInArrow(run, df.schema)


def new_proposals(proposals: DataFrame, known: DataFrame) -> DataFrame:
    """proposals (user_id, proposal_id, text) in the order of their ids without those that are like a known line (user_id, text) of the user or an accepted proposal.

    Blank and null proposals go.  The order decides, so a user's proposals are taken in blocks: those of a block first meet the known lines and what
    earlier blocks accepted, a block of them in a task, and what is left of them is folded in order.  A task holds one block; no pair leaves it.
    """
    strip = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    block = lambda *order: F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1) / BLOCK).cast("int")
    every = proposals.select("user_id", F.col("proposal_id").cast("long").alias("proposal_id"), strip.alias("text")).where("text <> ''")
    lines = known.select("user_id", strip.alias("text")).where("text <> ''").unionByName(every.where("proposal_id IS NULL").drop("proposal_id"))
    old = lines.distinct().withColumn("block", -1 - block("text")).select("user_id", F.lit(None).cast("long").alias("proposal_id"), "text", "block")
    # of equal texts only the first can be new: the others are like it, or like what it is like
    first = every.where("proposal_id IS NOT NULL").groupBy("user_id", "text").agg(F.min("proposal_id").alias("proposal_id")).select("user_id", "proposal_id", "text")
    rows = written(first.withColumn("block", block("proposal_id", "text")), "proposals")
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    state = written(old, "known")
    accepted = None

    for b in range(blocks):
        now = rows.where(F.col("block") == b).drop("block")
        users = state.select(F.col("user_id").alias("owner"), "block").distinct()
        asked = now.join(users.hint("merge"), F.col("user_id").eqNullSafe(F.col("owner"))).select("user_id", "block", F.lit(True).alias("is_new"), "proposal_id", "text")
        tiles = state.select("user_id", "block", F.lit(False).alias("is_new"), "proposal_id", "text").unionByName(asked)
        gone = judged(tiles, ["user_id", "block"], False).select(F.col("user_id").alias("owner"), F.col("text").alias("gone")).distinct()
        left = now.join(gone.hint("merge"), F.col("user_id").eqNullSafe(F.col("owner")) & (F.col("text") == F.col("gone")), "left_anti")
        kept = written(judged(left.withColumn("is_new", F.lit(True)), ["user_id"], True).select("user_id", "proposal_id", "text"), "accepted")
        accepted = kept if accepted is None else accepted.unionByName(kept)
        state = state.unionByName(kept.withColumn("block", F.lit(b)))
    return accepted


@query("new_proposals")
def new_proposals_q(spark, sf_dir) -> DataFrame:
    """JN-18 over the first sentence of each question; every fifth is known."""
    lines = query_log(spark, sf_dir).select("user_id", F.col("query_id").alias("proposal_id"), F.regexp_extract("text", r"(?s)^[^.?!\n]*", 0).alias("text"))
    return new_proposals(lines.where("proposal_id % 5 <> 0"), lines.where("proposal_id % 5 = 0"))
