from collections import Counter

import duckdb
import pytest

from wanderframe.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


CONVS = {1: [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")], 2: [("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "c é")], 3: [("user", "q")], 4: [("system", "s"), ("user", "")], 5: [("user", "q"), ("assistant", "a")], 6: [("user", "q"), ("assistant", "a")]}


def frame(spark):
    rows = [(c, i, r, t) for c, turns in CONVS.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost"), (7, 0, None, None)]
    return chat.conversations(spark.createDataFrame(rows[::-1], SCHEMA))


def test_pairs_share_a_prompt(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 1), (5, 6), (1, 99), (None, 1), (1, 2)], "chosen_id long, rejected_id long")
    got = chat.preferences(chat.paired(frame(spark), pairs)).collect()
    assert sorted((r.chosen_id, r.rejected_id, r.n_prompt_turns) for r in got) == [(1, 2, 3), (1, 2, 3), (1, 3, 1), (4, 1, 0), (5, 6, 2)]
    for r in got:
        c, d = CONVS[r.chosen_id], CONVS[r.rejected_id]
        k = r.n_prompt_turns
        assert (r.prompt, r.chosen, r.rejected) == (render(c[:k]), render(c[k:]), render(d[k:]))
        assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == [t + "<|im_end|>" for role, t in c[k:] if role == "assistant"]
        assert [r.rejected[s.start : s.end] for s in r.rejected_spans] == [t + "<|im_end|>" for role, t in d[k:] if role == "assistant"]


def test_neighbours_are_ranked_across_blocks(spark):
    rows = [(c, 0, "user", "same" if c % 3 else f"own {c}") for c in range(50)]
    convs = chat.conversations(spark.createDataFrame(rows, SCHEMA))
    ids = [c for c in range(50) if c % 3]
    want = list(zip(ids[::2], ids[1::2], strict=False))
    for block in (1, 4, 1024):
        assert sorted(tuple(r) for r in chat.neighbours(convs, block).collect()) == want


def brute_branches(convs):
    out, ids = [], sorted(convs)
    for c, turns in convs.items():
        other = ids[(ids.index(c) + 1) % len(ids)]
        at = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        if other != c and at:
            k = at[c % len(at)]
            out.append((c, other, turns, turns[:k] + convs[other][k:]))
    return out


def cut(c, r):
    k = next((i for i, (x, y) in enumerate(zip(c, r, strict=False)) if x != y), min(len(c), len(r)))
    return k, render(c[:k]), render(c[k:]), render(r[k:])


def test_branches_are_cut_where_they_part(spark):
    convs = {**CONVS, 7: [("", "")]}
    got = chat.preferences(chat.branched(frame(spark))).collect()
    want = [(a, b, *cut(c, r)) for a, b, c, r in brute_branches(convs)]
    assert sorted((r.chosen_id, r.rejected_id, r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in got) == sorted(want)


@pytest.mark.parametrize("ids", [range(100), range(0, 6400, 64), range(0, 100_000, 1000), range(-50, 50), [((i * 2654435761) % 2**40 - 2**39) for i in range(100)], [-(2**63), 0, 2**63 - 1], [5]])
def test_branches_of_any_ids(spark, ids):
    """Consecutive, spaced, negative, random and extreme ids: a row for every conversation
    with a trained turn and another one."""
    convs = {c: [("user", f"q{n % 3}"), ("assistant", f"a{n}"), ("user", "r"), ("assistant", "b" * (n % 4))] for n, c in enumerate(ids)}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    found = chat.conversations(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = chat.preferences(chat.branched(found)).collect()
    want = [(a, b, *cut(c, r)) for a, b, c, r in brute_branches(convs)]
    assert sorted((r.chosen_id, r.rejected_id, r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in got) == sorted(want)
    assert len(got) == (len(convs) if len(convs) > 1 else 0)


def test_empty(spark):
    none = chat.conversations(spark.createDataFrame([], SCHEMA))
    assert chat.preferences(chat.branched(none)).count() == 0 and chat.neighbours(none).count() == 0


def test_query_equals_sql(spark, tmp_path):
    """Nulls, ties, repeats, shared prefixes, very long and empty texts, clashing columns."""
    rows = [(c, i, r, t, "x") for c, turns in CONVS.items() for i, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "lost", "x"), (7, 0, None, None, "x"), (8, None, "user", "tie", "x"), (8, None, "assistant", "tie", "x"), (8, 1, "user", "\u00e9" * 50_000, "x"), (8, 1, "user", "\u00e9" * 50_000, "x")]
    rows += [(c, i, "assistant" if i % 2 else "user", "same" if i < 2 + c % 3 else f"{c}", "x") for c in range(90_000, 110_000, 100) for i in range(5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    table.coalesce(1).write.parquet(f"file://{tmp_path}/conversations.parquet")
    got = queries.op6_preferences(spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(queries.ORACLE["op6_preferences"])
    cols = [d[0] for d in found.description]
    want = Counter(found.fetchall())
    assert Counter(tuple(r) for r in got.select(*cols).collect()) == want
    assert {k[cols.index("kind")] for k in want} == {"shared", "branched"} and max(k[cols.index("n_prompt_turns")] for k in want) == 3
