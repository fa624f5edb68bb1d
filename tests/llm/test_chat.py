import random

from polyview.llm import catalog, chat

SF = "/root/testdata/sf0.001"


def brute(turns):
    """(pair, side, turn, role, text) rows to one tuple a pair."""
    pairs = {}
    for pair, side, turn, role, text in {(p, s, t, r or "", x or "") for p, s, t, r, x in turns}:
        pairs.setdefault(pair, {"chosen": [], "rejected": []})[side].append((turn is not None, turn or 0, role, text))
    out = []
    for pair, sides in pairs.items():
        a, b = ([t[2:] for t in sorted(sides[s])] for s in chat.SIDES)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        show = lambda ts: "".join(f"<|{r}|>\n{x}<|end|>\n" for r, x in ts)
        row = [pair, show(a[:n])]
        for own in (a[n:], b[n:]):
            at, mask = 0, []
            for r, x in own:
                size = len(show([(r, x)]))
                if r == "assistant":
                    mask.append(f"{at + len(r) + 5}:{at + size}")
                at += size
            row += [show(own), ",".join(mask)]
        out.append((*row, n, len(a) - n, len(b) - n))
    return sorted(out)


def run(spark, turns):
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")
    return sorted(tuple(r) for r in chat.preference_texts(df).collect())


def test_random_pairs_equal_brute_force(spark):
    draw = random.Random(9)
    turns = []
    for pair in range(60):
        shared = [(draw.choice(["user", "assistant"]), draw.choice(["é hi", "", "x", "y|>\n"])) for _ in range(draw.randint(0, 4))]
        for side in chat.SIDES:
            own = shared + [(draw.choice(["user", "assistant", "system"]), draw.choice(["p", "q é", ""])) for _ in range(draw.randint(0, 3))]
            turns += [(pair, side, 2 * k, r, x) for k, (r, x) in enumerate(own)]
    turns += turns[::7]
    assert run(spark, turns) == brute(turns)


def test_odd_rows(spark):
    turns = [(1, "chosen", None, None, None), (1, "rejected", None, None, None), (1, "chosen", 3, "assistant", "long " * 40000), (2, "rejected", 0, "user", "alone"),
             (3, "chosen", 0, "user", "b"), (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a"), (3, "rejected", 0, "user", "a")]
    assert run(spark, turns) == brute(turns)
    assert run(spark, []) == []
    rows = [(None, 0, "user", "x", "y"), (4, 0, "user", "x", "y"), (5, 0, "user", "x", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    assert [tuple(r)[:4] for r in chat.preference_texts(chat.neighbours(df)).collect()] == [(2, "<|user|>\nx<|end|>\n", "", "")]


def test_query_over_all_conversations(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    turns = [(r["conv_id"] // 2, chat.SIDES[r["conv_id"] % 2], r["turn"], r["role"], r["text"]) for r in rows]
    assert sorted(tuple(r) for r in catalog.QUERIES["op8_preferences"](spark, SF).collect()) == brute(turns)
