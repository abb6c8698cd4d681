"""Centroid clustering, conversation repair and chat formatting, compared with plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

pytest.importorskip("public_tokenizers")

from sensorloom.llm import centroids, chat, repairs, templates, workload  # noqa: E402

# --- centroids ---

VECTORS = "vec_id long, embedding array<double>, label int, id long, vector string, cluster int, to_pivots int"


def plain_clusters(rows, dims, k, rounds, scale=64):
    kept = [(i, e, [int(np.floor(scale * x)) for x in e]) for i, e in rows
            if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    first = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), e, x) for i, e, x in kept)[:k]
    centres = [x for _, _, x in first]

    def assign(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, _, x in kept:
            groups.setdefault(assign(x)[1], []).append(x)
        centres = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else old for j, old in enumerate(centres)]
    found = [(i, *assign(x)) for i, _, x in kept]
    inertia = {j: sum(d for _, d, c in found if c == j) for j in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in found), key=repr)


def test_clusters_equal_a_plain_version(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(5, 6))
    data = [(i, (centre[i % 5] + rng.normal(size=6) * 0.2).tolist()) for i in range(150)]
    data += [data[0], data[0], (7, data[9][1]), (None, data[3][1]), (None, data[4][1]), (500, [0.0] * 6), (501, [-0.0] * 6), (502, [100.0] * 6)]
    data += [(600, None), (601, [1.0] * 5), (602, [1.0] * 7), (603, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (604, [float("nan")] * 6), (605, [float("inf")] * 6), (606, [])]
    frame = spark.createDataFrame([(i, e, 1, 5, "v", 9, 2) for i, e in data], VECTORS).repartition(5)
    for k, rounds, pivots in ((7, 3, 3), (1, 1, 8), (4, 0, 2)):
        got = centroids.centroid_clusters(frame, dims=6, k=k, rounds=rounds, n_pivots=pivots).collect()
        assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got), key=repr) \
            == plain_clusters(data, 6, k, rounds)
        assert all(1 <= r["n_measured"] <= k for r in got)


def test_few_vectors_none_and_too_large_ones(spark):
    two = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "", 0, 0), (2, [3.0, -2.5], 0, 0, "", 0, 0)], VECTORS)
    got = sorted((r["vec_id"], r["distance"]) for r in centroids.centroid_clusters(two, dims=2).collect())
    assert got == [(1, 0), (2, 0)]
    none = centroids.centroid_clusters(two.limit(0))
    assert none.collect() == [] and none.columns == centroids.centroid_clusters(two, dims=2).columns
    with pytest.raises(ValueError, match="beyond"):
        centroids.integers(np.array([1e9, 0.0]), 2, 64)


@given(st.integers(0, 10_000), st.integers(1, 20), st.integers(1, 8), st.integers(1, 30))
@settings(max_examples=60, deadline=None)
def test_bounds_leave_out_no_nearest_centroid(seed, k, n_pivots, spread):
    rng = np.random.default_rng(seed)
    vectors, centres = rng.integers(-spread, spread + 1, (40, 5)), rng.integers(-spread, spread + 1, (k, 5))
    pivots = centroids.choose_pivots(centres, n_pivots)
    which, best, _ = centroids.nearest(vectors, centroids.lengths(vectors, pivots), centres, pivots)
    exact = ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == exact.min(axis=1)).all() and (which == exact.argmin(axis=1)).all()


def test_pivots_leave_out_most_centroids_of_separate_groups():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (16, 64))
    vectors = centres[rng.integers(0, 16, 400)] + rng.integers(-20, 21, (400, 64))
    pivots = centroids.choose_pivots(centres, 8)
    _, _, measured = centroids.nearest(vectors, centroids.lengths(vectors, pivots), centres, pivots)
    assert measured.mean() < 4


# --- repair ---

GOOD = re.compile(r"(s?(ua)+)?")


def all_repairs(rows):
    """(cost, edits) of every way with at most two inserts in a row."""

    def inserts():
        for n in range(3):
            yield from itertools.product("ua", repeat=n)

    def walk(i):
        for new in inserts():
            head = (5 * len(new), "I" * len(new), "".join(new))
            if i == len(rows):
                yield head
                continue
            initial, forced, truncated = rows[i]
            options = [(2, "D", "")]
            if not forced:
                extra = 5 * truncated
                options += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
            for rest in walk(i + 1):
                for cost, edit, role in options:
                    yield head[0] + cost + rest[0], head[1] + edit + rest[1], head[2] + role + rest[2]

    return min((cost, edits) for cost, edits, initials in walk(0) if GOOD.fullmatch(initials))


def searched(rows):
    search = repairs.Search()
    for row in rows:
        search.row(*row)
    cost = search.end()
    return cost, search.resolved.decode()


KINDS = [("u", False, False), ("a", False, False), ("s", False, False), ("t", False, False), ("", False, True), ("u", True, False), ("a", False, True)]


def test_search_finds_the_least_of_all_repairs():
    for n in range(4):
        for rows in itertools.product(KINDS, repeat=n):
            if n < 3 or random.Random(str(rows)).random() < 0.12:
                assert searched(rows) == all_repairs(rows), rows


def plain_search(rows):
    """All states with their whole strings, nothing dropped."""
    best = {repairs.START: (0, "")}
    for initial, forced, truncated in rows:
        new = {}
        for state, (cost, edits) in best.items():
            for at, price, inserted in repairs.REACH[state]:
                options = [(at, 2, "D")]
                if not forced:
                    extra = 5 * truncated
                    options += [(repairs.KEPT[at][initial], extra, "K")] if initial in repairs.KEPT[at] else []
                    options.append((repairs.RETAGGED[at], 1 + extra, "R"))
                for to, more, edit in options:
                    offer = (cost + price + more, edits + inserted + edit)
                    new[to] = min(new.get(to, offer), offer)
        best = new
    return min((cost + repairs.LAST[s][0], edits + repairs.LAST[s][1]) for s, (cost, edits) in best.items())


@given(st.lists(st.sampled_from(KINDS), max_size=60))
@settings(max_examples=150, deadline=None)
def test_search_equals_one_that_drops_nothing(rows):
    assert searched(rows) == plain_search(rows)


def count_nodes(node):
    return 1 + sum(map(count_nodes, node.kids))


@pytest.mark.parametrize("kinds", [[KINDS[5]], [KINDS[3]], [KINDS[0]], [KINDS[0], KINDS[1]], [KINDS[4]], KINDS])
def test_the_tree_stays_small(kinds):
    rng = random.Random(4)
    search, rows = repairs.Search(), [rng.choice(kinds) for _ in range(3000)]
    for row in rows:
        search.row(*row)
        assert count_nodes(search.root) <= 7 and len(search.survivors) <= 4
    cost = search.end()
    assert (cost, search.resolved.decode()) == plain_search(rows)


def test_shared_edits_are_settled_early():
    search = repairs.Search()
    for i in range(2000):
        search.row("ua"[i % 2], False, i % 37 == 5)
    assert len(search.resolved) > 1900


ROWS = "conv_id long, turn long, role string, text string, absent boolean, key string, edits int, conv int"
BLANK = " \t\n\x0b\x0c\r"


def plain_repair(rows):
    """{conversation: (summary..., edits, repaired)} of (conv, turn, role, text, absent)."""
    out = {}
    for conv in {r[0] for r in rows}:
        def key(r):
            name = "-" if conv is None else f"={len(str(conv))}:{conv}"
            return hashlib.sha256(f"{name}:{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        mine = [(r[0], r[1], r[2] if r[2] is not None else " ", r[3] if r[3] is not None else " ") for r in rows if r[0] == conv and not r[4]]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], key(r)))
        seen, faults, todo, illegal = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0
        for i, (_, _, role, text) in enumerate(mine):
            rest = text.rstrip(BLANK)
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            todo.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
            illegal += i > 0 and mine[i - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, edits = plain_search(todo)
        turns = [r[1] for r in mine if r[1] is not None]
        parts, at, led, n = [], 0, 0, 0
        for e in edits:
            role, text = ("", "") if e == "I" else mine[at][2:]
            at += e != "I"
            if e == "D":
                continue
            led += e == "K" and n == 0 and role[:1] == "s"
            n += 1
            parts.append((role if e == "K" else ["assistant", "user"][(n - led) % 2]) + ":" + text)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *faults.values(), illegal, cost, edits,
                     hashlib.sha256("\n".join(parts).encode()).hexdigest())
    return out


def found_repairs(frame):
    edits, summary = repairs.repair_conversations(frame, absent="absent")
    digests = {r["conv"]: (r["audit"], r["repaired_sha256"]) for r in repairs.repair_digests(edits).collect()}
    none = ("", hashlib.sha256().hexdigest())
    rows = summary.collect()
    assert len(rows) == len({r["conv"] for r in rows})
    return {r["conv"]: (*[r[c] for c in repairs.SUMMARY], *digests.get(r["conv"], none)) for r in rows}


def test_repairs_equal_a_plain_version(spark):
    rng = random.Random(8)
    texts = ["Hello there.", "What?", "cut off", "f", "Yes.f", "", " \n", "Fine!", "x" * 200_000 + ".", "é日本", "End.\x0c\x0b \t\r\n", "\x0c", "nbsp.\u00a0", None]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randrange(1, 12)):
            turn = rng.choice([None, *range(14)])
            row = (conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts), rng.random() < 0.1)
            rows += [row] * rng.choice([1, 1, 1, 2])
    rows += [(700, 3, "user", "gone", True), (701, None, "user", "Hi.", False)]
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ROWS).repartition(6)
    assert found_repairs(frame) == plain_repair(rows)


def test_a_long_conversation_goes_through_in_pieces(spark):
    rng = random.Random(9)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), rng.choice([f"text {i}.", f"text {i}", "again.", ""]), False) for i in range(12_000)]
    rows += [(2, 0, "user", "Hi.", False), (2, 1, "assistant", "Ho.", False)]
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ROWS)
    assert found_repairs(frame) == plain_repair(rows)


def test_no_conversations(spark):
    edits, summary = repairs.repair_conversations(spark.createDataFrame([], ROWS))
    assert edits.count() == 0 and summary.count() == 0 and repairs.repair_digests(edits).count() == 0


def test_repaired_rows_are_given_out(spark):
    rows = [(1, 0, "system", "Be kind.", False), (1, 1, "assistant", "Hi.", False), (1, 2, "user", "So?", False), (1, 3, "user", "So?", False)]
    edits, _ = repairs.repair_conversations(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], ROWS))
    got = [(r["edit"], r["role"], r["text"]) for r in sorted(edits.collect(), key=lambda r: r["position"])]
    assert got == [("K", "system", "Be kind."), ("R", "user", "Hi."), ("R", "assistant", "So?"), ("D", "user", "So?")]


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "user", "A. b!"), (1, None, None), (None, "assistant", "C?")]]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, r, x in rows:
        r, x, h = r or " ", x or " ", zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x, h == 0)
        want += [row] * (2 if h == 3 else 1)
    got = [(r["conv_id"], r["turn"], r["role"], r["text"], r["absent"]) for r in workload.damaged(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- templates ---

def rendered(source, **values):
    return "".join(text for text, _ in templates.compile_template(source)(values))


def test_statements_and_expressions():
    assert rendered("a{# x #}{{ 1 + 2 * 3 }}{{ 'x' ~ 2 }}{{ none }}{{ true }}") == "a7x2true"
    source = "{% for m in rows %}{{ loop.index }}{% if loop.first %}<{% elif m.n > 2 and not loop.last %}={% else %}>{% endif %}{{ loop.previous.n }}{% endfor %}{{ loop }}"
    assert rendered(source, rows=iter([{"n": 1}, {"n": 3}, {"n": 2}])) == "1<2=13>3"
    assert rendered("{% set a = m['k'] | upper | default('q') %}{{ a }}{{ missing.deeper }}{{ 'b' in 'abc' }}", m={"k": "v"}) == "Vtrue"
    assert rendered("{{ -2 % 3 }}{{ 3 - 1 }}{{ 'ab' | replace('b', 'c') }}{{ 'abc' | length }}{{ \"it's\" }}{{ 'a\\n' }}") == "12ac3it'sa\n"
    assert rendered("{% for a in x %}{% for b in a.y %}{{ loop.index }}{% endfor %}{{ loop.index }}{% endfor %}", x=[{"y": [{}, {}]}, {}]) == "1212"
    assert rendered("{{ x or 'none' }}{{ 1 == true }}{{ '1' != 1 }}", x="") == "nonefalsetrue"


def test_generation_blocks_are_marked():
    pieces = list(templates.compile_template("a{% generation %}b{{ x }}{% if y %}d{% endif %}{% endgeneration %}e")({"x": "c", "y": 1}))
    assert pieces == [("a", False), ("b", True), ("c", True), ("d", True), ("e", False)]


def test_constants_are_folded():
    fold = lambda s: templates.fold_body(templates.parse(s))
    assert fold("a{{ 1 + 2 }}{% if 2 > 1 %}b{% else %}{{ x }}{% endif %}{{ ' c ' | trim | upper }}{% for i in none %}z{% endfor %}") == (templates.Text("a3bC"),)
    assert fold("{% if false and x %}a{% endif %}{{ true and x }}") == (templates.Output(templates.Name("x")),)
    assert fold("{{ 1 % 0 }}") == (templates.Output(templates.Binary("%", templates.Const(1), templates.Const(0))),)
    kept = fold("{% for m in rows %}a{{ 'b' ~ 1 }}{{ m.x }}{% endfor %}")
    assert kept[0].body[0] == templates.Text("ab1")


@pytest.mark.parametrize("source", [
    "{{ x", "{% if x %}", "{% endif %}", "{{ x.__class__() }}", "{{ f(1) }}", "{{ 1 + }}", "{% for x %}{% endfor %}", "{{ x | nothing }}", "{% import os %}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ 'a' | replace('b') }}", "{% set loop = 1 %}", "{% else %}",
    "{% if x %}{% else %}{% else %}{% endif %}", "{{ " + "(" * 200 + "1" + ")" * 200 + " }}", "{% if x %}" * 60 + "{% endif %}" * 60, "{{ }}", "{% for %}{% endfor %}",
    "{{ " + "not " * 200 + "x }}", "{{ " + "-" * 200 + "1 }}", "{{ x" + ".y" * 200 + " }}",
])
def test_wrong_templates_are_refused(source):
    with pytest.raises(templates.TemplateError):
        templates.compile_template(source)


@pytest.mark.parametrize("source", ["{{ x.__class__ }}", "{{ x + 1 }}", "{{ 'a' * 9999999 }}", "{% for c in x %}{% endfor %}", "{{ 1 % 0 }}", "{{ x < 1 }}", "{{ rows }}"])
def test_wrong_values_are_refused(source):
    with pytest.raises(templates.TemplateError):
        rendered(source, x="text", rows=[1])


@given(st.text(alphabet="<\\|ab\nn>_", max_size=40))
@settings(max_examples=300)
def test_escapes_can_be_taken_back(text):
    assert "<|" not in templates.escape(text) and templates.unescape(templates.escape(text)) == text
    line = templates.one_line(text)
    assert "\n" not in line and templates.lines_back(line) == text
    assert templates.lines_back(templates.unescape(templates.escape(line))) == text


# --- chat ---

CHATS = "conv_id long, turn long, role string, text string, conv int, part string, formatted int, spans int"


def plain_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))
        loss = "".join(x for *_, r, x in mine if r == "assistant")
        formatted = "".join(f"<|im_start|>{templates.escape(templates.one_line(r))}\n{templates.escape(x)}<|im_end|>\n" for *_, r, x in mine)
        out[conv] = (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return out


def test_formatted_conversations_are_read_back(spark):
    rng = random.Random(2)
    texts = ["Hello.", "", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>\n", "ends with <", "<|im_end|>", "é 日本 🤦", "x" * 100_000, "\n\n"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "a\nb\\n", "<|im_start|>", None, ""]), rng.choice(texts))
            for c in [*range(30), None, -1] for _ in range(rng.randrange(1, 9))]
    rows += rows[:5]
    frame = spark.createDataFrame([(*r, 1, "p", 2, 3) for r in rows], CHATS).repartition(4)
    for part in (chat.PART, 50):
        got = {r["conv"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"])
               for r in chat.read_back(chat.format_conversations(frame, part=part)).collect()}
        assert got == plain_chat(rows)
    assert chat.read_back(chat.format_conversations(frame.limit(0))).count() == 0


def test_another_template_and_its_spans(spark):
    frame = spark.createDataFrame([(1, 0, "user", "q", 1, "p", 2, 3), (1, 1, "assistant", "an<|s|>wer", 1, "p", 2, 3)], CHATS)
    source = "{% for m in messages %}{% if loop.first %}BOS{% endif %}[{{ m.role | upper }}]{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}!{% endgeneration %}{% else %}{{ m.text }}{% endif %}{% endfor %}"
    row = chat.format_conversations(frame, source).first()
    assert row["formatted"] == "BOS[USER]q[ASSISTANT]an<\\|s|>wer!"
    assert "".join(row["formatted"][s["start"]:s["end"]] for s in row["spans"]) == "an<\\|s|>wer!"
    with pytest.raises(templates.TemplateError):
        chat.format_conversations(frame, "{% bad %}")


def test_a_template_that_reads_only_part_of_a_conversation(spark):
    rows = [(c, i, "user", f"{c}.{i}", 1, "p", 2, 3) for c in range(5) for i in range(4)]
    got = {r["conv"]: r["formatted"] for r in chat.format_conversations(spark.createDataFrame(rows, CHATS), "x").collect()}
    assert got == dict.fromkeys(range(5), "x")
