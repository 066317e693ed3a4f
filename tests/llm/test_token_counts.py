import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import token_counts
from threadloom.llm.common import table

PATH = public_tokenizers.path(token_counts.VOCABULARY)
PARTS = ["a", "the", "ing", "'", "'s", "'re", "'r", "'ll", "s", " ", "  ", "\n", "\t", "1", "234", "!", "...", "é", "日本", "\xa0", "\x1c", "🙂", "<|endoftext|>", "<|", "----"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.Machine(f.read(), 500)


def counts(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), st.text(max_size=40)))
def test_counts_equal_the_librarys_while_states_are_forgotten(library, machine, text):
    assert machine.count(text) == counts(library, [text])[0]


def test_state_maps_compose_in_any_grouping(machine):
    rng = random.Random(3)
    for k in range(60):
        text = "".join(rng.choice(PARTS) for _ in range(200)) if k else "x" * 900
        size, fan = rng.randint(1, 40), rng.randint(2, 5)
        maps = [machine.chunk_map(text[i : i + size]) for i in range(0, len(text), size)]
        while len(maps) > 1:
            maps = [machine.compose(maps[i : i + fan]) for i in range(0, len(maps), fan)]
        assert machine.total(*maps[0]) == machine.count(text)


def test_a_transition_carries_the_change_of_the_count(machine):
    at, total = machine.start, 0
    for n, ch in enumerate("the reading", 1):
        at, change = at[ch]
        total += change
        if ch != " ":
            assert total == machine.count("the reading"[:n])


def test_operator_on_whole_table_edges_and_long_texts(spark, data, library, edge, edge_texts, nothing):
    long = ["<|endoftext|> word's 12\n" * 700, "y" * 9000, "y" * 9000, " " * 7000]
    docs = edge.unionByName(spark.createDataFrame([(None, t, "en", None, 1, 1, 0.5, "k") for t in long], edge.schema))
    got = sorted(r[0] for r in token_counts.count_tokens(docs, PATH, chunk=1000).select("n_tokens").collect())
    assert got == sorted(counts(library, edge_texts + long))
    assert token_counts.count_tokens(edge, PATH).columns == [*edge.columns, "n_tokens"]
    assert token_counts.count_tokens(nothing, PATH).count() == 0
    rows = table(spark, data, "documents").select("doc_id", "text").collect()
    want = {r.doc_id: n for r, n in zip(rows, counts(library, [r.text for r in rows]), strict=True)}
    found = token_counts.query(spark, data).where(F.col("n_tokens") > 512).where("over_limit").count()
    assert found == sum(n > 512 for n in want.values())
    assert {r.doc_id: r.n_tokens for r in token_counts.query(spark, data).collect()} == want
    assert {(r.doc_id, r.n_bytes) for r in token_counts.query(spark, data).collect()} == {(r.doc_id, len((r.text or "").encode())) for r in rows}


def test_other_kinds_of_vocabulary_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_counts.Machine(f.read())
