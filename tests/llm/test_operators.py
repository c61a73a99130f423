"""The operators of the llm subpackage against brute force, exact round trips and defined edge cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weftline.llm")

from weftline.llm import canonical, entities, leakage, spelling, splitting, tokenizer, vector_neighbours, visual_form  # noqa: E402
from weftline.llm import queries as llm_queries  # noqa: E402


def rows(df):
    return {tuple(r) for r in df.collect()}


# --- 1: similar vectors ---------------------------------------------------------------------------------------------------


def brute_neighbours(vectors: dict[int, list[float]], k: int) -> dict[int, list[int]]:
    ids = sorted(vectors)
    x = np.array([np.float32(vectors[i]) for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for n, i in enumerate(ids):
        s = np.round(np.einsum("ij,j->i", x, x[n]), 9)
        out[i] = [ids[j] for j in np.lexsort((ids, -s)) if j != n][:k]
    return out


def test_similar_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 8))
    vectors = {int(i): (centres[i % 12] + 0.4 * rng.standard_normal(8)).tolist() for i in range(700)}
    vectors |= {1000 + i: vectors[3] for i in range(60)}  # a hot vector
    vectors |= {2000 + i: [2 * x for x in vectors[4]] for i in range(3)}  # the same direction
    bad = [(5000, None), (5001, [0.0] * 8), (5002, [1.0] * 7), (5003, [float("nan")] + [1.0] * 7), (5004, [float("inf")] + [1.0] * 7), (5005, []), (5006, [None] + [1.0] * 7)]
    data = [*vectors.items(), *bad, (0, vectors[0])]
    df = spark.createDataFrame(data, "datum_id bigint, embedding array<float>").withColumn("vid", F.lit(1)).withColumn("h", F.lit("x"))
    near = vector_neighbours.similar_vectors(df, width=8, k=5, leaf_rows=64, visits=40, trees=6).collect()
    got: dict[int, list] = {}
    for r in sorted(near, key=lambda r: (r["datum_id"], r["rank"])):
        got.setdefault(r["datum_id"], []).append(r["neighbour"])
    want = brute_neighbours(vectors, 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits / (5 * len(want)) > 0.97
    assert got[1059] == [3, 1000, 1001, 1002, 1003] == want[1059] and got[3] == [1000, 1001, 1002, 1003, 1004]


def test_leaves_beyond_the_sample_are_split_on(spark):
    """A tiny sample fits a few leaves only; the tasks split them on, so no scan grows with the data."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 8))[rng.integers(0, 40, 5000)] + 0.3 * rng.standard_normal((5000, 8))
    vectors = dict(enumerate(x.tolist()))
    df = spark.createDataFrame(list(vectors.items()), "datum_id bigint, embedding array<float>")
    near = vector_neighbours.similar_vectors(df, width=8, k=5, leaf_rows=32, visits=24, trees=4, sample_rows=60).collect()
    want, got = brute_neighbours(vectors, 5), {}
    for r in near:
        got.setdefault(r["datum_id"], set()).add(r["neighbour"])
    assert sum(len(got[i] & set(want[i])) for i in want) / (5 * len(want)) > 0.9
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    sizes = [len(m) for m, _ in vector_neighbours.parts_of(unit, unit[:500], 32)]
    assert max(sizes) <= vector_neighbours.SPLIT_FROM * 32 and sum(sizes) >= 4000


def test_a_vector_that_a_third_of_all_rows_hold(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.standard_normal(8).tolist() for i in range(400)} | {1000 + i: [1.0] * 8 for i in range(200)}
    df = spark.createDataFrame([*vectors.items(), (1001, [1.0] * 8)], "datum_id bigint, embedding array<float>")
    got = [sorted(tuple(r) for r in vector_neighbours.similar_vectors(df, width=8, hot_rows=h).collect()) for h in (100, 10**9)]
    assert got[0] == got[1] and len(got[0]) == 5 * 600


def test_similar_vectors_of_few_and_none(spark):
    none = spark.createDataFrame([], "datum_id bigint, embedding array<float>")
    assert vector_neighbours.neighbour_pairs(none, width=2).collect() == []
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "datum_id bigint, embedding array<float>")
    assert rows(vector_neighbours.neighbour_pairs(two, width=2)) == {(1, 2)}
    one = spark.createDataFrame([(1, [1.0, 0.0])], "datum_id bigint, embedding array<float>")
    assert vector_neighbours.neighbour_pairs(one, width=2).collect() == []


def test_forest_finds_homes_first():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = vector_neighbours.Forest([vector_neighbours.fit_tree(x, 16, rng) for _ in range(3)])
    home, reached = forest.home(x), forest.search(x, 8)
    assert all(set(h) <= set(r) for h, r in zip(home[:, :1].tolist(), reached.tolist(), strict=True)) or np.mean([h[0] in r for h, r in zip(home, reached, strict=True)]) > 0.9


# --- 2: splitting ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(25))
def test_pieces_cover_and_fit(seed):
    r = random.Random(seed)
    words = ["word", "longerword", "x" * r.randint(1, 400), "文章", "é", "\r\n", "\n\n", "## Head\n", ". ", "。", "\t"]
    text = "".join(r.choice(words) + r.choice(["", " ", "\n"]) for _ in range(r.randint(0, 900)))
    limit, overlap = r.choice([(2000, 200), (300, 50), (100, 0), (50, 49)])
    found = splitting.pieces(text, limit, overlap)
    assert found[0][1] == 0 and found[-1][2] == len(text)
    for (lead, a, b), following in itertools.zip_longest(found, found[1:]):
        assert b - a + lead <= limit and 0 <= lead <= overlap and (b > a or not text)
        assert lead <= a
        if following:
            assert following[1] == b


def test_natural_boundaries_come_first():
    text = ("Sentence one is here. " * 30 + "\n\n") * 4
    for lead, a, b in splitting.pieces(text, 800, 100)[:-1]:
        assert text[:b].endswith("\n\n") or text[:b].endswith(". ")
        assert lead == 0 or a - lead == 0 or text[a - lead - 1].isspace()
    sections = "\n".join(f"## Part {i}\n" + "text " * 100 for i in range(6))
    assert all(sections[a:].startswith("## ") for _, a, _ in splitting.pieces(sections, 1200, 0))


def test_split_sections(spark):
    long = "a" * 4500
    data = [(1, "H", "short"), (2, None, long), (2, None, long), (3, "E", ""), (4, "N", None), (5, "Edge", "b" * 2000), (6, "Over", "b" * 2001), (7, "Astral", "😀" * 2001)]
    df = spark.createDataFrame(data, "section_id bigint, heading string, body string").withColumn("piece", F.lit(1))
    got = splitting.split_sections(df).collect()
    count = {i: sum(r["section_id"] == i for r in got) for i in range(1, 8)}
    assert count == {1: 1, 2: 3, 3: 1, 4: 0, 5: 1, 6: 2, 7: 2}
    mine = sorted((r for r in got if r["section_id"] == 2), key=lambda r: r["piece_no"])
    assert "".join(r["piece"][r["lead"] :] for r in mine) == long and all(r["heading"] is None and r["n_chars"] == len(r["piece"]) <= 2000 for r in mine)
    assert splitting.split_sections(df.where("false")).collect() == []


# --- 3: canonical list ----------------------------------------------------------------------------------------------------

ENTRIES = [
    ("site:north-bay", "site", "North Bay"),
    ("site:bletraleigh", "site", "Bletralêigh"),
    ("role:senior-data-planner", "role", "Senior Data Planner"),
    ("role:senior-water-planner", "role", "Senior Water Planner"),
    ("department:urban-laboratory-division", "department", "Urban Laboratory Division"),
    ("system:ticket-lookup-engine", "system", "Ticket Lookup Engine"),
    ("role:chief-quality-buyer", "role", "Chief Quality Buyer"),
]
MEANT = {
    "North Bay": "site:north-bay", "the NORTH bay?": "site:north-bay", "Bay, North": "site:north-bay", "bletralegh": "site:bletraleigh", "Sr Data Planner": "role:senior-data-planner",
    "planner for senior data (tbc)": "role:senior-data-planner", "UrbanLaboratoryDivision": "department:urban-laboratory-division", "Urban Lab. Division, see notes": "department:urban-laboratory-division",
    "@ticket_lookup_engine": "system:ticket-lookup-engine", "Tikcet Lookup Enigne v2": "system:ticket-lookup-engine", "T.L.E.": "system:ticket-lookup-engine", "Chief QA Buyer": "role:chief-quality-buyer",
    "Urban Division": "department:urban-laboratory-division", "senior planner": "unmatched", "the data thing": "unmatched", "": "unmatched", "???": "unmatched", "the": "unmatched", "Senior Data Planner Desk": "unmatched",
    "n/a": "unmatched", "x11": "unmatched", "ｎｏｒｔｈ Bay": "site:north-bay",
}


def test_canonical_mapping(spark):
    data = [(i, None, v) for i, v in enumerate(MEANT)] + [(900, "site", None), (0, None, "North Bay"), (901, None, "x " * 5000)]
    df = spark.createDataFrame(data, "loose_id bigint, type_guess string, descriptor string").withColumn("o", F.lit(0)).withColumn("id", F.lit("z"))
    entries = spark.createDataFrame(ENTRIES, "id string, type string, name string")
    got = {r["loose_id"]: r["suggestion_id"] for r in canonical.map_to_canonical(df, entries).collect()}
    assert {v: got[i] for i, v in enumerate(MEANT)} == MEANT
    assert got[900] == got[901] == "unmatched" and len(got) == len(MEANT) + 2
    assert {r[1] for r in canonical.map_to_canonical(df, entries.where("false")).collect()} == {"unmatched"}
    assert canonical.map_to_canonical(df.where("false"), entries).collect() == []


def test_guess_breaks_ties(spark):
    entries = spark.createDataFrame([("a:x", "a", "Blue Gate"), ("b:x", "b", "Blue Gate")], "id string, type string, name string")
    df = spark.createDataFrame([(1, "b", "blue gate"), (2, None, "blue gate")], "loose_id bigint, type_guess string, descriptor string")
    assert rows(canonical.map_to_canonical(df, entries)) == {(1, "b:x"), (2, "unmatched")}


def test_long_entries_and_words(spark):
    long = "International Bureau of Weights Measures Standards Calibration Metrology and Comparison"
    word = "".join(random.Random(9).choice("abcdefghij") for _ in range(120))
    entries = spark.createDataFrame([*ENTRIES, ("site:long", "site", long), ("brand:word", "brand", f"Brand {word}")], "id string, type string, name string")
    typed = {long.replace("Weights", "Weihgts").replace("Metrology", "Metrolgy"): "site:long", f"Brand {word[:60]}{word[61:]}": "brand:word", f"Brand {word[:40]}xy{word[42:90]}z{word[91:]}": "unmatched", "x" * 30000: "unmatched"}
    df = spark.createDataFrame([(i, None, v) for i, v in enumerate(typed)], "loose_id bigint, type_guess string, descriptor string")
    assert dict(rows(canonical.map_to_canonical(df, entries))) == dict(enumerate(typed.values()))


def test_answers_do_not_change_with_unrelated_entries(spark):
    """A thousand further entries of other words raise all weights alike; only matches among themselves may be new."""
    df = spark.createDataFrame([(i, None, v) for i, v in enumerate(MEANT)], "loose_id bigint, type_guess string, descriptor string")
    more = [(f"x:{i}", "x", f"Qu{i:04d}ovz Zz{i:04d}wqq") for i in range(1000)]
    whole = [rows(canonical.map_to_canonical(df, spark.createDataFrame(e, "id string, type string, name string").repartition(p))) for e, p in ((ENTRIES, 1), (ENTRIES + more, 5))]
    assert whole[0] == whole[1]


@pytest.mark.parametrize("seed", range(20))
def test_distance_and_deletes(seed):
    r = random.Random(seed)
    a = "".join(r.choice("abc") for _ in range(r.randint(4, 9)))
    b = list(a)
    for _ in range(2):
        i = r.randrange(len(b))
        edit = r.choice("sdia")
        if edit == "d" and len(b) > 3:
            del b[i]
        elif edit == "i":
            b.insert(i, r.choice("abc"))
        elif edit == "s" and i + 1 < len(b):
            b[i], b[i + 1] = b[i + 1], b[i]
        else:
            b[i] = r.choice("abc")
    b = "".join(b)

    def slow(x, y):  # optimal string alignment by its definition
        d = {(-1, -1): 0} | {(i, -1): i + 1 for i in range(len(x))} | {(-1, j): j + 1 for j in range(len(y))}
        for i in range(len(x)):
            for j in range(len(y)):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x[i] != y[j]))
                if i and j and x[i] == y[j - 1] and x[i - 1] == y[j]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(x) - 1, len(y) - 1]

    assert spelling.distance(a, b, 9) == slow(a, b)
    if slow(a, b) <= 2:
        assert spelling.near_keys(a, 2) & spelling.near_keys(b, 2)
    assert all(spelling.distance(a, b, m) == min(slow(a, b), m + 1) for m in range(4))


@pytest.mark.parametrize("seed", range(20))
def test_long_words_share_a_key(seed):
    r = random.Random(seed)
    a = "".join(r.choice("abcd") for _ in range(r.randint(36, 90)))
    b = a
    for _ in range(2):
        i = r.randrange(len(b) - 1)
        b = r.choice([b[:i] + b[i + 1 :], b[:i] + "x" + b[i:], b[:i] + "y" + b[i + 1 :], b[:i] + b[i + 1] + b[i] + b[i + 2 :]])
    assert spelling.distance(a, b, 2) <= 2 and spelling.near_keys(a, 2) & spelling.near_keys(b, 2)


# --- 4: names -------------------------------------------------------------------------------------------------------------

SAME = [
    ["Elizabeth Marrowfield", "Liz Marrowfield", "MARROWFIELD Elizabeth", "Marrowfield, E.", "Elisabeth Marrowfeild (Records)", "Dr. Elizabeth Q. Marrowfield, planner", "elizabeth_marrowfield", "marrowfielde"],
    ["Tom Marrowfield", "Thomas Marrowfield?"],
    ["Kestrelbank & Sons Logistics Ltd", "Kestrelbank Logistics", "contact at Kestrelbank Log. Ltd", "the Kestrélbank LOGISTICS people", "KESTRELBANK"],
    ["Oldhavenn Foods S.A.", "Oldhaven Foods"],
]
NOBODY = ["the auditors", "someone from Data", "unknown", "???", "", "that meter reviewer", "new hire in Records", "person at the front desk"]


def test_names_link(spark):
    data, want = [], set()
    for group in SAME:
        keys = [f"k{len(data) + i:03d}" for i in range(len(group))]
        hint = "organisation" if any(w in group[0] for w in ("Ltd", "S.A.")) else "person"
        data += [(k, n, hint) for k, n in zip(keys, group, strict=True)]
        want |= set(itertools.combinations(keys, 2))
    data += [(f"n{i}", n, "person") for i, n in enumerate(NOBODY)] + [("n99", None, "person"), data[0], ("long", "x" * 20000, "person")]
    names = spark.createDataFrame(data, "key string, name string, hint string").withColumn("form", F.lit(1)).withColumn("label", F.lit(1))
    assert rows(entities.entity_pairs(names)) == want
    assert entities.entity_pairs(names.where("false")).collect() == []


def test_a_name_that_fits_two_joins_neither(spark):
    data = [("a", "Thomas Quillfeather", "person"), ("b", "Theodore Quillfeather", "person"), ("c", "T. Quillfeather", "person"), ("d", "Quillfeather Foods Ltd", "organisation"), ("e", "Quillfeather Energy Ltd", "organisation"), ("f", "Quillfeather", "organisation")]
    assert entities.entity_pairs(spark.createDataFrame(data, "key string, name string, hint string")).collect() == []


def test_names_align_over_all_their_tokens(spark):
    data = [("a", "Anna Garcia Lopez", "person"), ("b", "Garcia Lopez, Anna", "person"), ("c", "Blue Harbour Foods Ltd", "organisation"), ("d", "Red Harbour Foods Ltd", "organisation"), ("e", "Harbour Foods", "organisation"), ("f", "Harbour Blue Foods", "organisation")]
    assert rows(entities.entity_pairs(spark.createDataFrame(data, "key string, name string, hint string"))) == {("a", "b"), ("c", "f")}


def test_assignment_is_the_best_one():
    r = random.Random(1)
    for _ in range(500):
        n = r.randint(1, 4)
        w = [[r.choice([0, 0.5, 0.9, 1]) for _ in range(5)] for _ in range(n)]
        got = spelling.assign(w)
        assert len(set(got)) == n
        assert abs(sum(w[i][j] for i, j in enumerate(got)) - max(sum(w[i][p[i]] for i in range(n)) for p in itertools.permutations(range(5), n))) < 1e-9


def test_names_outside_the_tables_link(spark):
    data = [("a", "Wolfgang Meyer", "person"), ("b", "Meyer, Wolfgang", "person"), ("c", "W. Meyer", "person"), ("d", "Acme Bakery", "organisation"), ("e", "Acme Bakery Ltd", "organisation"), ("f", "Best Bakery Ltd", "organisation"), ("g", "Jill Henderson", "person"), ("h", "henderson", "person")]
    assert rows(entities.entity_pairs(spark.createDataFrame(data, "key string, name string, hint string"))) == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e"), ("g", "h")}


def test_short_names_link(spark):
    data = [("a", "Wei Li", "person"), ("b", "Li, Wei", "person"), ("c", "Ana Kim", "person"), ("d", "Ana Kim", "person"), ("e", "ABB Robotics", "organisation"), ("f", "ABB Robotics Ltd", "organisation"), ("g", "KUK Robotics", "organisation"), ("h", "Wei Lu", "person")]
    assert rows(entities.entity_pairs(spark.createDataFrame(data, "key string, name string, hint string"))) == {("a", "b"), ("c", "d"), ("e", "f")}


def test_names_of_any_letters_and_length_link(spark):
    same = [("Ann Lee", "Ann Lee"), ("Wei Li", "Li, Wei"), ("Anna Maria van der Berg", "Berg, Anna Maria van der"), ("Иван Петров", "Петров, Иван"), ("王小明", "王小明"), ("Na Li", "Na Li"), ("Sue Ng", "NG Sue")]
    firms = [("New Horizons Ltd", "New Horizons Ltd"), ("IBM", "IBM"), ("Acme Bakery", "Acme Bakery")]
    data = [(f"{h}{i}{side}", n, h) for h, pairs in (("person", same), ("organisation", firms)) for i, both in enumerate(pairs) for side, n in zip("ab", both, strict=True)]
    data += [("x1", "new hire in Records", "person"), ("x2", "new hire in Records", "person"), ("x3", "NA", "person"), ("x4", "NA", "person"), ("x5", "New Supplier", "organisation"), ("x6", "New Supplier", "organisation")]
    want = {(f"{h}{i}a", f"{h}{i}b") for h, pairs in (("person", same), ("organisation", firms)) for i in range(len(pairs))}
    assert rows(entities.entity_pairs(spark.createDataFrame(data, "key string, name string, hint string"))) == want


def test_long_chains_of_links_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(f"{i:05d}", f"{i + 1:05d}") for i in range(1200)], "a string, b string")
    vertices = edges.select(F.col("a").alias("form")).union(spark.createDataFrame([("01200",), ("zz",)], "form string"))
    got = dict(tuple(r) for r in entities.components(vertices, edges).collect())
    assert got == {f"{i:05d}": "00000" for i in range(1201)} | {"zz": "zz"}


def test_open_names_without_a_full_one_link(spark):
    pairs = [("J. Hendersen", "J. Henderson", "person"), ("Heimtrijack Group", "Heimtrjack Group", "organisation"), ("Glulpegrust Ltd", "Glulpegrst Ltd", "organisation"), ("Swanbridge", "K. Swanbridge", "person")]
    data = [(f"{i}{side}", n, hint) for i, (*both, hint) in enumerate(pairs) for side, n in zip("ab", both, strict=True)]
    data += [("x", "Okonkwell", "person"), ("y", "A. Okonkwell", "person"), ("z", "B. Okonkwell", "person")]
    assert rows(entities.entity_pairs(spark.createDataFrame(data, "key string, name string, hint string"))) == {(f"{i}a", f"{i}b") for i in range(4)}


def test_shortened_lines_and_middle_initials():
    reader = entities.NameReader()
    read = lambda n, h: reader.read(n, h)
    assert reader.open(read("Kestrelbank Constr. SA", "organisation"))
    assert reader.agree(read("Kestrelbank Constr. SA", "organisation"), read("Kestrelbank Construction", "organisation")) == 2
    assert reader.agree(read("F. Marrowfield", "person"), read("Charles F. Marrowfield", "person")) == 0


def test_node_names(spark):
    data = [("p:1", "person", '{"name": "A B"}'), ("p:2", "person", '{"name": " ", "aliases": ["C D", "E F"]}'), ("p:3", "person", '{"aliases": "G H"}'), ("p:4", "person", "{broken"), ("p:5", "person", None), ("s:1", "system", '{"name": "X"}'), ("p:1", "person", '{"name": "A B"}')]
    got = rows(entities.node_names(spark.createDataFrame(data, "id string, type string, frontmatter string")))
    assert got == {("p:1", "A B", "person"), ("p:2", "C D", "person"), ("p:2", "E F", "person"), ("p:3", "G H", "person")}


# --- 6: tokens ------------------------------------------------------------------------------------------------------------

TEXTS = ["", " ", "Hello world", "don't we'll I'm", "aaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 3000, " \n\n\t x  ", "naïve café 東京 🚀👨‍👩‍👧 \x00 �", "<|endoftext|>", "x1234567 ___ ...", "件" * 700, "é é", "  tab", "a b\r\nc"]


def test_tokens_equal_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer.BYTE_BPE_50K)
    t.encode_special_tokens = True
    r = random.Random(5)
    texts = TEXTS + ["".join(r.choice("abcde ABC .,'\n12éß日本👍") for _ in range(r.randint(1, 300))) for _ in range(200)]
    data = [(i, x) for i, x in enumerate(texts)] + [(9000, None), (9001, TEXTS[2])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: list(r["ids"]) for r in tokenizer.encode_corpus(df).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in data}
    assert tokenizer.encode_corpus(df.where("false")).collect() == []


# --- 7: leaks -------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    r = random.Random(2)
    vocabulary = [f"w{i}q" for i in range(4000)]
    items = [(i, " ".join(r.sample(vocabulary, n))) for i, n in enumerate([60, 15, 40, 300, 9])]
    noise = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    w = [t.split() for _, t in items]
    docs = {
        1: noise(50) + " " + " ".join(w[0][20:35]) + " " + noise(80),
        2: noise(30) + " " + " ".join(w[0][20:29]) + " " + noise(80),  # nine words are no case
        3: "**" + items[1][1].upper().replace(" ", " ") + "**",
        4: " ".join(w[2][:7] + ["changed"] + w[2][8:15] + w[2][16:24] + ["added"] + w[2][24:40]),
        5: noise(210_000) + " " + " ".join(w[3][100:130]).replace("w", "ｗ") + " " + noise(300),
        6: " ".join(r.sample(w[0], 60)),  # all the words, shuffled
        7: items[4][1],  # too short an item
        8: "",
        9: items[0][1] + " " + items[1][1],
        11: "​".join(items[1][1][i : i + 3] for i in range(0, len(items[1][1]), 3)),
        12: "before " + "&nbsp;".join(w[2][3:20]) + " behind",
        13: " ".join(x for i, word in enumerate(w[3][:25]) for x in (["worse", word] if i % 3 == 0 else [word])) + " " + " ".join(w[3][25:42]),  # a poor part, then a clean one
    }
    data = [*docs.items(), (10, None), (1, docs[1])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    frame = spark.createDataFrame([*items, items[0], (77, None)], "item_id bigint, text string")
    assert rows(leakage.leaked_items(df, frame)) == {(1, 0), (3, 1), (4, 2), (5, 3), (9, 0), (9, 1), (11, 1), (12, 2), (13, 3)}
    assert leakage.leaked_items(df, frame.where("false")).collect() == []
    assert leakage.leaked_items(df.where("false"), frame).collect() == []


def test_leaks_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"v{i}x{j}" for j in range(30))) for i in range(9)]
    df = spark.createDataFrame([(i, "intro " + t + " end") for i, t in items], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 500)
    assert rows(leakage.leaked_items(df, spark.createDataFrame(items, "item_id bigint, text string"))) == {(i, i) for i in range(9)}


@pytest.mark.parametrize("seed", range(10))
def test_shared_runs_share_a_sketch_entry(seed):
    r = random.Random(seed)
    run = [f"s{r.randint(0, 10**6)}" for _ in range(5)]
    a = [f"a{i}" for i in range(r.randint(0, 9))] + run + [f"b{i}" for i in range(r.randint(0, 9))]
    b = [f"c{i}" for i in range(r.randint(0, 9))] + run + [f"d{i}" for i in range(r.randint(0, 9))]
    known = {}
    assert set(leakage.sketch(leakage.shingles(leakage.hashes(a, known)))[0]) & set(leakage.sketch(leakage.shingles(leakage.hashes(b, known)))[0])


def test_shingles_left_are_a_lower_bound():
    r = random.Random(4)
    for _ in range(3000):
        n = leakage.MATCHED + r.randint(0, 12)
        errors = n // (leakage.ERROR_IN - 1)
        marks = [False] * errors + [True] * n
        r.shuffle(marks)
        runs = [sum(1 for _ in g) for ok, g in itertools.groupby(marks) if ok]
        assert sum(max(0, k - leakage.SHINGLE + 1) for k in runs) >= leakage.left_of(n)


# --- 8: visual forms ------------------------------------------------------------------------------------------------------


def test_forms(spark):
    same = [["Café über", "Café über", "Ｃａｆé über", "Саfé über", "C​afé ü­ber"], ["ofﬁce", "office"], ["гайка й", "гaйкa й"], ["line\r\nend", "line\nend"], ["ガ", "ｶﾞ", "ガ"], ["Kelvin", "Kelvin"]]
    other = ["cafe über", "CAFÉ ÜBER", "Café  über", "Café\nüber", "Cafe1", "Cafel", "straße", "strasse", "x2", "x²"]
    texts = [t for g in same for t in g] + other + ["", " ​", None, "　"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    form = {r["text"]: r["form"] for r in visual_form.visual_form(df).collect()}
    for g in same:
        assert len({form[t] for t in g}) == 1, g
    distinct = [form[g[0]] for g in same] + [form[t] for t in other]
    assert len(set(distinct)) == len(distinct) and form[None] is None
    want = {tuple(sorted((texts.index(a), texts.index(b)))) for g in same for a, b in itertools.combinations(g, 2)}
    assert rows(visual_form.lookalike_pairs(df)) == want
    assert visual_form.lookalike_pairs(df.where("false")).collect() == []


def test_forms_of_a_given_table_and_in_slices(spark, tmp_path, monkeypatch):
    table = tmp_path / "confusables.txt"
    table.write_text("# note\n1D00 ;\t0061 ;\tMA\t# small capital a\n0131 0307 ; 0069 ; MA\n")
    monkeypatch.setattr(visual_form, "SLICE_BYTES", 10)
    df = spark.createDataFrame([(0, "bᴀnd Ⅷ"), (1, "band VIII"), (2, None), (3, "x" * 50), (4, "ᎻᎪᏞᎢ"), (5, "HALT")], "doc_id bigint, text string").coalesce(1)
    form = [r["form"] for r in visual_form.visual_form(df, confusables=str(table)).orderBy("doc_id").collect()]
    assert form == ["band VIII", "band VIII", None, "x" * 50, "HALT", "HALT"]
    assert rows(visual_form.lookalike_pairs(df)) == {(4, 5)}


def test_copies_pair_with_variants_only(spark):
    data = [(i, "same text") for i in range(30)] + [(100, "same text"), (101, "ѕame text"), (0, "same text"), (200, "alone"), (201, "alone")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("form_key", F.lit(1)).withColumn("text_key", F.lit(1))
    got = rows(visual_form.lookalike_pairs(df))
    assert got == {(i, j) for i in range(30) for j in (100, 101)} | {(100, 101)}


# --- the queries ----------------------------------------------------------------------------------------------------------


def test_every_query_runs(spark, sf):
    for name, f in llm_queries.queries().items():
        df = f(spark, sf)
        assert df.columns and df.count() >= 0, name


def test_found_columns(spark, sf):
    want = {"p1_found": ["datum_id_a", "datum_id_b"], "p2_found": ["section_id"], "p3_found": ["loose_id", "suggestion_id"], "p4_found": ["key_a", "key_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"]}
    for name, columns in want.items():
        assert llm_queries.queries()[name](spark, sf).columns == columns


def test_found_vectors_agree_with_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embedding_datum.parquet").select("datum_id", "embedding").collect()
    usable = {r[0]: r[1] for r in table if r[1] and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    want = {tuple(sorted((i, j))) for i, near in brute_neighbours(usable, 5).items() for j in near}
    assert rows(llm_queries.p1_found(spark, sf)) == want
