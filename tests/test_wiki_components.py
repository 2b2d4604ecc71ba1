import random

from tessella.operators import graph, wiki

SCHEMA = "user_id string, type string, title string, slug string, content string, refs array<string>, confidence double, seq long"
FIELDS = ("user_id", "type", "title", "slug", "content", "refs", "confidence", "action")


def made(n, seed, new):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(40)] + ["deep", "learning", "中", "文"]
    out = []
    for k in range(n):
        title = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4])))
        if rng.random() < 0.05:
            title = rng.choice(["", "?!", "a"])
        slug = rng.choice(["same", "same-2", "same-3", "other", f"s{k}", f"s{k}-4"])
        out.append((f"u{rng.randrange(3)}", rng.choice(["claim", "topic", "concept", "doc_summary", "odd"]), title, slug if new else f"{slug}-x{k}" if rng.random() < 0.7 else slug, f"c{k}" * rng.choice([1, 1, 1500]), [f"r{rng.randrange(9)}", f"r{k}"], rng.choice([0.5, 0.8, 0.98]), k))
    return out


def sequential(existing, candidates, as_of):
    from tessella.functions.titles import title_similarity

    kinds = {"doc_summary": 0, "topic": 1, "concept": 2, "claim": 3}
    out, stats = [], {}
    for user in sorted({r[0] for r in existing + candidates}):
        rows = [[*r[:7], "keep"] for r in sorted((r for r in existing if r[0] == user), key=lambda r: r[7])]
        done = stats.setdefault(user, [0, 0])
        for c in sorted((r for r in candidates if r[0] == user), key=lambda r: (kinds.get(r[1], 9), r[7])):
            scores = [title_similarity(c[2], r[2]) for r in rows]
            top = max(range(len(rows)), key=lambda k: (scores[k], -k), default=None)
            text = c[4][: wiki.CONTENT_LIMIT]
            if top is not None and scores[top] >= wiki.DUPLICATE:
                r = rows[top]
                r[4] = f"{r[4]}\n\n--- Update {as_of} ---\n{text}"[: 2 * wiki.CONTENT_LIMIT]
                r[5], r[6] = list(dict.fromkeys([*r[5], *c[5]])), min(1.0, r[6] + 0.05)
                r[7] = "update" if r[7] == "keep" else r[7]
                done[1] += 1
            else:
                slug, k = c[3], 2
                while slug in {r[3] for r in rows}:
                    slug, k = f"{c[3]}-{k}", k + 1
                rows.append([user, c[1], c[2], slug, text, c[5], c[6], "create"])
                done[0] += 1
        out += rows
    return out, stats


def key(rows):
    return sorted(tuple(map(str, r)) for r in rows)


def test_components_fold_to_what_one_fold_gives(spark):
    for seed in (1, 2):
        old, new = made(60, seed, False), made(160, seed + 10, True)
        frames = [spark.createDataFrame(r, SCHEMA) for r in (old, new)]
        merged = wiki.merge_entries(*frames, "2024-01-01")
        got = merged.collect()
        want, stats = sequential(old, new, "2024-01-01")
        assert key([[r[f] for f in FIELDS] for r in got]) == key(want)
        assert {r.user_id: [r.created, r.updated] for r in wiki.merge_statistics(merged).collect()} == stats
    # The whole-user fold gives the same entries.
    batch = wiki.merge_batch(*frames, "2024-01-01").collect()
    assert key([[r[f] for f in FIELDS] for r in batch]) == key(want)


def test_fused_texts_and_empty_sides(spark):
    old, new = made(20, 5, False), made(40, 6, True)
    none = spark.createDataFrame([], SCHEMA)
    a, b = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    assert wiki.merge_entries(none, none, "d").count() == 0
    assert {r.action for r in wiki.merge_entries(a, none, "d").collect()} == {"keep"}
    fused = wiki.merge_entries(a, b, "d", fuse=lambda x, y: f"[{x[:3]}|{y[:3]}]")
    assert any(r.content.startswith("[") for r in fused.collect())
    calls = wiki.merge_statistics(fused, fused=True).collect()
    assert all(r.fusion_calls == r.updated for r in calls) and sum(r.updated for r in calls) > 0


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(300)] + [(5000, 5001 + k) for k in range(50)] + [(9, 9), (7000, 7000), (None, 1)]
    group = {}
    for a, b in edges:
        if a is not None:
            group.setdefault(a, a)
            group.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "source long, target long")).collect()}
    assert got == group
    assert graph.connected(spark.createDataFrame([], "source long, target long")).count() == 0


def test_first_alone_is_the_greedy_choice(spark):
    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)} | {(k, k + 1) for k in range(200, 215)}
    linked = {a: {x for p in pairs if a in p for x in p} - {a} for p in pairs for a in p}
    stay = set()
    for a in sorted(linked):
        if not linked[a] & stay:
            stay.add(a)
    got = [r.node for r in wiki.first_alone(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()]
    assert sorted(got) == sorted(stay)


def test_a_user_of_one_component_is_no_single_group(spark):
    """All titles share tokens: the old fold put them into one pandas group, and compared each with every one before."""
    old = [("u", "topic", f"brand size x{k % 3}y", f"s{k}", f"c{k}", [f"r{k}"], 0.5, k) for k in range(60)]
    new = [("u", "claim", f"brand size x{k % 3}y", "s", f"n{k}", [f"r{k}"], 0.5, k) for k in range(600)]
    merged = wiki.merge_entries(*[spark.createDataFrame(r, SCHEMA) for r in (old, new)], "2024-01-01")
    want, _ = sequential(old, new, "2024-01-01")
    assert key([[r[f] for f in FIELDS] for r in merged.collect()]) == key(want)
    assert max(r.merges for r in merged.collect()) == 200
    texts = merged._jdf.queryExecution().toString()
    assert "component" not in texts and not hasattr(wiki, "_fold")
