import random
import re
import time
from collections import Counter

import pytest
from folioframe.llm.quotes import introduces, link_quotations, passages, threads, unquoted
from pyspark.sql import functions as F

MESSAGES = "conv_id long, turn long, role string, text string"


def test_levels_are_parsed():
    found = passages("hi\n> one\n> > two\n>>two b\n>\nbye")
    assert found == [(0, ["hi"]), (1, ["one"]), (2, ["two", "two b"]), (1, [""]), (0, ["bye"])]
    assert unquoted(found) == "hi\nbye"
    assert unquoted(passages("On Monday, Ann wrote:\n> x\nyes")) == "yes"
    assert unquoted(passages("a > b\n 3 > 2")) == "a > b\n 3 > 2"


ROWS = [
    (1, 0, "user", "Where is the copper bridge?\n\nAnd who built it?"),
    (1, 1, "assistant", "> And who built it?\nNobody knows."),
    (1, 2, "user", "Unrelated question."),
    (1, 3, "assistant", "> > And WHO   built it?\n> Nobody knows.\nReally?"),
    (1, 4, "user", "> Unrelated question.\n> not said by anyone\nAnswer."),
    (1, 5, "user", "> something nobody said\nEh?"),
    (1, 6, "user", "> Really?\nYes."),
    (2, 0, "user", "> Nobody knows.\nquote from elsewhere"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (2, 2, "user", ""),
    (None, 0, "user", "alone"),
    (None, 1, None, "> alone\nwith you"),
    (3, None, "user", "> x\nno turn"),
]


def test_links_threads_and_order(spark):
    out = link_quotations(spark.createDataFrame(ROWS, MESSAGES).withColumn("h", F.lit(1)).withColumn("own", F.lit("x")).withColumn("TURN_", F.lit(0))).collect()
    assert len(out) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in out}
    assert {k: by[k].parent_turn for k in by} == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 1, (1, 4): 2, (1, 5): None, (1, 6): 3, (2, 0): None, (2, 1): None, (2, 2): None, (None, 0): None, (None, 1): 0, (3, None): None}
    assert [(r.turn, r.root_turn, r.reply_depth) for r in out if r.conv_id == 1] == [(0, 0, 0), (1, 0, 1), (3, 0, 2), (6, 0, 3), (2, 2, 0), (4, 2, 1), (5, 5, 0)]
    assert by[1, 3].text == "Really?" and by[1, 3].n_quotes == 2 and by[1, 3].n_linked == 2 and by[1, 3].levels == 2
    assert by[2, 1].text is None and by[2, 2].text == ""
    assert link_quotations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_first_speaker_is_the_original_even_if_all_repeat_it(spark):
    rows = [(1, i, "user", f"ok\nline {i}" if i % 2 else f"> ok\n> line {i - 1}\nok") for i in range(60)]
    out = {r.turn: r for r in link_quotations(spark.createDataFrame(rows, MESSAGES)).collect()}
    for turn, r in out.items():
        if turn % 2 == 0:
            # the whole passage "ok line k" was said only at k; its line "ok" at 0
            assert r.parent_turn == (turn - 1 if turn else None)


def test_long_chains(spark):
    links = spark.createDataFrame([("=1", i, i - 1) for i in range(1, 300)], "c string, turn long, parent long")
    assert {(r.turn, r.root, r.depth) for r in threads(links).collect()} == {(i, 0, i) for i in range(1, 300)}


def test_lines_that_introduce_a_quote():
    yes = ["On Monday, Ann wrote:", " On " + "x " * 5000 + "wrote :", "Am 3. Mai schrieb Jo Doe:", "Le 3 mai Ann a écrit :", "El lunes Ana escribió:"]
    no = ["On wrote:", "On Monday Ann wrote", "Then Ann wrote:", "Le 3 mai Ann écrit:", "", ":", "schrieb Am x:"]
    assert all(map(introduces, yes)) and not any(map(introduces, no))


def test_long_messages():
    for text in ("> " * 300_000 + "x", ">" * 500_000, "> a\n" * 200_000, "On " * 300_000 + ":\n> x", "Am " + "schrieb " * 200_000 + "\n> x", " \t" * 300_000, "\n" * 500_000):
        began = time.time()
        unquoted(passages(text))
        assert time.time() - began < 10


def brute_links(rows):
    """Parent, root and depth of each (conv, turn), with plain texts in place of hashes and no joins."""
    plain = lambda t: " ".join(t.casefold().split())

    def split(text):
        runs = []
        for line in (text or "").split("\n"):
            level, rest = 0, line.lstrip(" \t")
            if not rest.startswith(">"):
                rest = line
            while level == 0 and rest.startswith(">") or level and rest.startswith(">"):
                level, rest = level + 1, rest[1:]
                if rest[:1] in (" ", "\t"):
                    rest = rest[1:]
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(rest)
        return runs

    said, quotes = {}, {}
    for conv, turn, _, text in rows:
        if turn is None:
            continue
        runs = split(text)
        pieces = [lines for level, lines in runs if not level]
        mine = unquoted([(level, list(lines)) for level, lines in runs])
        pieces += [block.split("\n") for block in re.split(r"\n\s*\n", mine)] + [mine.split("\n")]
        own = {plain(" ".join(lines)) for lines in pieces} | {plain(line) for lines in pieces for line in lines}
        said.setdefault((conv, turn), set()).update(own - {""})
        quotes.setdefault((conv, turn), []).append([(level, lines) for level, lines in runs if level and plain(" ".join(lines))])
    parent = {}
    for (conv, turn), all_quotes in quotes.items():
        first = lambda what: min((t for c, t in said if c == conv and what in said[c, t]), default=turn)  # noqa: B023, E731
        for own in all_quotes:
            linked = []
            for no, (level, lines) in enumerate(own):
                votes = Counter()
                whole = plain(" ".join(lines))
                if first(whole) < turn:
                    votes[first(whole)] += 1_000_000
                for line in {plain(x) for x in lines} - {"", whole}:
                    if first(line) < turn:
                        votes[first(line)] += 1
                if votes:
                    linked.append((level, no, min(votes, key=lambda t: (-votes[t], t))))
            if linked:
                parent[conv, turn] = min(parent.get((conv, turn), turn), min(linked)[2])
    out = {}
    for conv, turn in quotes:
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out[conv, turn] = (parent.get((conv, turn)), root, depth)
    return out


@pytest.mark.parametrize("rows_bound", [500_000, 0])
def test_links_against_brute_force(spark, rows_bound):
    rng = random.Random(8)
    lines = [f"{a} {b}" for a in ("the river", "a stone", "old copper", "late winter") for b in ("is here", "was gone", "sings")]
    rows = []
    for conv in (1, 2, None, 3):
        texts = []
        for turn in range(40 if conv == 1 else 12):
            body = []
            if texts and rng.random() < 0.7:
                quoted = rng.choice(texts).split("\n")
                start = rng.randrange(len(quoted))
                body += [rng.choice(["> ", ">", " > "]) + q.upper() for q in quoted[start : start + rng.randint(1, 3)]]
            if rng.random() < 0.3:
                body += ["> > " + rng.choice(lines), "> " + rng.choice(lines)]
            body += [rng.choice([*lines, "", f"only {conv} {turn}"]) for _ in range(rng.randint(1, 3))]
            texts.append("\n".join(body))
            rows.append((conv, turn, "user", texts[-1]))
    out = link_quotations(spark.createDataFrame(rows, MESSAGES), rows=rows_bound).collect()
    assert {(r.conv_id, r.turn): (r.parent_turn, r.root_turn, r.reply_depth) for r in out} == brute_links(rows)
    assert sum(r.parent_turn is not None for r in out) > 20


def test_one_conversation_that_holds_most_messages(spark):
    rows = [(1, 0, "user", "the one question\nof all"), *((1, i, "user", f"> the one question\nanswer {i}") for i in range(1, 900)), *((i, 0, "user", "alone") for i in range(2, 50)), *((1, 900, "user", "> of all\nsame"),) * 300]
    out = link_quotations(spark.createDataFrame(rows, MESSAGES), rows=0).collect()
    assert len(out) == len(rows) and sum(r.parent_turn == 0 for r in out) == 899 + 300
    assert [(r.conv_id, r.root_turn, r.reply_depth, r.turn) for r in out] == sorted((r.conv_id, r.root_turn, r.reply_depth, r.turn) for r in out)
