"""Trimmed quotes link: some lines, paragraphs, sentences or words of an earlier message."""

import random

from gridwatch.llm.quotations import conversations, reply_ordered

ORIGINAL = "The first line is here. It has two sentences.\nA second line follows it\nThe third line ends the paragraph.\n\nNext paragraph speaks of boats and of rivers.\n\nLast one, on trains."


def test_trimmed_quotes(spark):
    quotes = {
        10: "> A second line follows it\n> The third line ends the paragraph.",
        11: "> Next paragraph speaks of boats and of rivers.\n>\n> Last one, on trains.",
        12: "> It has TWO sentences.",
        13: "> paragraph speaks of boats and of",
        14: "> The third line ends the\n> paragraph. Next paragraph speaks of\n> boats",
        15: "> A second line follows it\n> Last one, on trains.",
        20: "> Yes.\n> Words that nobody has said so far",
        21: "> Last one, on planes.",
    }
    rows = [(1, 0, "user", "Yes."), (1, 1, "user", ORIGINAL), (1, 2, "user", "Last one, on trains.\nAnd more."), (1, 3, "user", "Yes.")]
    rows += [(1, t, "assistant", f"{q}\nReply {t}") for t, q in quotes.items()]
    rows += [(2, 0, "user", quotes[10]), (2, 1, "user", ORIGINAL), (None, 2, "user", quotes[10])]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = reply_ordered(table).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None} == {(1, t): 1 for t in range(10, 16)}


def test_conversations_against_brute_force(spark):
    """Random conversations whose messages quote whole lines of earlier ones, at up to two levels: parents and order, step by step."""
    rng = random.Random(31)
    lines = [f"Line {w} of {v}." for w in ("one", "two", "three", "four") for v in ("red", "green", "blue")]
    rows, want = [], []
    for conv in range(25):
        own, parents = [], []
        for turn in range(rng.randrange(1, 14)):
            text, parent = [], None
            if turn and rng.random() < 0.7:
                levels = [rng.choice(rng.choice(own)) for _ in range(rng.choice([1, 1, 2]))]
                text = ["> " * (k + 1) + x.upper() for k, x in enumerate(levels)]
                first = {x: min(t for t, o in enumerate(own) if x in o) for x in levels}
                parent = first[levels[0]]
            own.append([rng.choice(lines) for _ in range(rng.randrange(1, 3))])
            parents.append(parent)
            rows.append((conv, turn, "user", "\n".join([*text, *own[-1]]), "x"))

        def below(t, parents=parents):
            return [t, *(y for x, p in enumerate(parents) if p == t for y in below(x))]

        order = [y for t, p in enumerate(parents) if p is None for y in below(t)]
        want.append((conv, 0, order, "".join("<|user|>\n" + "\n".join(own[t]) + "\n" for t in order)))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    assert sorted((r.conv_id, r.part, list(r.turns), r.text) for r in conversations(table).collect()) == want
    parts = sorted((r.conv_id, r.part, list(r.turns)) for r in conversations(table, turns_a_part=2).collect())
    assert [sum((t for c, _, t in parts if c == conv), []) for conv, *_ in want] == [order for _, _, order, _ in want]
    odd = spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "b"), (1, None, None, None)], "conv_id long, turn long, role string, text string")
    assert sorted(r.text for r in conversations(odd).collect()) == ["<|user|>\na\n", "<|user|>\nb\n", "<||>\n\n"] and conversations(odd.limit(0)).count() == 0
