import heapq
import itertools
import random

from hirelens.llm import chat as C


def cheapest(roles):
    """By a search over all repairs, cheapest first; a state is (messages done, last role)."""
    heap, done = [(0, 0, "")], set()
    while heap:
        cost, k, last = heapq.heappop(heap)
        if (k, last) in done:
            continue
        done.add((k, last))
        if k == len(roles) and last == "assistant":
            return cost
        for x in C.LEGAL[last or None]:
            heapq.heappush(heap, (cost + C.INSERT, k, x))
            if k < len(roles):
                r = roles[k]
                heapq.heappush(heap, (cost + (0 if r == x else C.RELABEL if r in C.ROLES else C.NAME), k + 1, x))
        if last and k < len(roles):
            r = roles[k]
            heapq.heappush(heap, (cost + C.MERGE + (0 if r == last else C.RELABEL if r in C.ROLES else C.NAME), k + 1, last))


def test_against_brute_force():
    kinds = ("system", "user", "assistant", "tool")
    for n in range(1, 6):
        for roles in itertools.product(kinds, repeat=n):
            cost, steps = C.repair(roles)
            assert cost == cheapest(roles)
            paid = {"insert": C.INSERT, "keep": 0, "name": C.NAME, "relabel": C.RELABEL, "merge": C.MERGE}
            assert cost == sum(C.MERGE + (C.RELABEL if roles_left(roles, steps, k) in C.ROLES else C.NAME) if w == "merge_as" else paid[w] for k, (w, _) in enumerate(steps))
            turns = [x for w, x in steps if not w.startswith("merge")]
            assert sum(w != "insert" for w, _ in steps) == n
            assert turns[-1] == "assistant" and all(b in C.LEGAL[a] for a, b in zip([None, *turns], turns))


def roles_left(roles, steps, k):
    return roles[sum(w != "insert" for w, _ in steps[:k])]


def test_round_trip(spark):
    rng = random.Random(0)
    rows = [(c, t, rng.choice(["user", " Assistant", "SYSTEM", "bot", None]), f"text {c} {t} <|x|>") for c in range(40) for t in range(rng.randint(1, 7))]
    got = {r.conv_id: r for r in C.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for c in range(40):
        own = [r for r in rows if r[0] == c]
        cost, steps = C.repair(tuple((r[2] or "").strip().lower() for r in own))
        r = got[c]
        assert r.cost == cost and r.n_messages == len(own) and r.n_turns == r.rendered.count("<|im_start|>") == r.rendered.count("<|im_end|>")
        texts = [t for block in r.rendered.split("<|im_start|>")[1:] for t in block.partition("\n")[2].removesuffix("<|im_end|>\n").split("\n\n") if t]
        assert texts == [x[3].replace("<|", "< |") for x in own]
        assert [b.partition("\n")[0] for b in r.rendered.split("<|im_start|>")[1:]] == [x for w, x in steps if not w.startswith("merge")]


def test_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, None, "assistant", "late"), (2, 5, "user", "early"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b" * 200_000), (None, 0, "user", "x"), (4, 0, "user", "b"), (4, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id int, turn int, role string, text string, cost int")
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert got[2].rendered == "<|im_start|>user\nearly<|im_end|>\n<|im_start|>assistant\nlate<|im_end|>\n"
    assert got[3].n_messages == 2 and got[3].cost == 0
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    assert C.format_chats(df.limit(0)).count() == 0
    assert C.repair(()) == (0, ())
