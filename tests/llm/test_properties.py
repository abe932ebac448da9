"""Properties that hold for any input."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import html_extract, language_id, near_dedup, queries, token_files

TEXT = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n.,!?;:*#$%&|()<>='\"éßǺ̈abcXYZ019")), max_size=60)
encode = token_files.ChunkEncoder(queries.tokenizer_path(), "<u2")


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_chunks_encode_as_whole_texts(texts):
    whole = [e.ids + [1] for e in encode.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids, counts = encode(pa.array(texts), 1)
    assert counts.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_code_round_trip(values):
    control, data = token_files.encode_values(np.array(values, dtype=np.uint32))
    assert token_files.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/ =\"'!-abpdivulescriptarticle&;#\n"), max_size=120))
def test_any_page_parses(page):
    tree = html_extract.parse(page)
    e = html_extract.expression(tree)
    assert html_extract.packed(html_extract.unpacked(*html_extract.packed(e))) == html_extract.packed(e)
    wrapper = html_extract.judged(html_extract.expression(e, e), 2)
    text = html_extract.main_text(tree, wrapper)
    assert "\n\n" not in text and text == text.strip()
    # Every element of the page has its part in the wrapper.
    stack = [(tree, wrapper)]
    while stack:
        node, own = stack.pop()
        assert own is not None
        stack += [x for x in zip(node[1], html_extract._placed(node[1], own)) if not isinstance(x[0], str)]


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5), st.integers(1, 4))
def test_shingles_are_those_of_the_words(texts, k):
    import re

    for text, own in zip(texts, near_dedup.shingle_sets(pa.array(texts, pa.string()), k), strict=True):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        lower = [w.translate({c: c + 32 for c in range(65, 91)}) for w in words]
        want = {tuple(lower[i : i + k]) for i in range(len(lower) - k + 1)} if len(lower) >= k else {tuple(lower)} if lower else set()
        assert len(own) == len(want)


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_letters(texts):
    assert language_id.has_letter(texts).tolist() == [any(c.isalpha() for c in t.lower()) for t in texts]
