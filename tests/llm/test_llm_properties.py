import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointlens.llm.bpe import BpeModel, Encoder
from pointlens.llm.html import extract_text
from pointlens.llm.queries import tokenizer_path
from pointlens.llm.secrets import RULES, trigram_query
from pointlens.llm.tokenfile import WordEncoder, pack, unpack

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
LIBRARIES = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
ENCODER = Encoder(BpeModel.load(BYTE))
WORDS = WordEncoder(open(WORD, encoding="utf-8").read())
texts = st.text(st.characters(codec="utf-8"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_any_text_is_encoded_and_decoded_like_the_library(text):
    ids = ENCODER.encode(pa.array([text], pa.large_string()))[0]
    assert ids.tolist() == LIBRARIES[BYTE].encode(text, add_special_tokens=False).ids
    assert ENCODER.decode([ids])[0].decode() == text
    assert WORDS.encode(pa.array([text], pa.large_string()))[0].tolist() == LIBRARIES[WORD].encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 20).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, (1 << bits) - 1), max_size=50))), st.data())
def test_packing_gives_back_any_part(packed, data):
    bits, ids = packed
    start = data.draw(st.integers(0, len(ids)))
    n = data.draw(st.integers(0, len(ids) - start))
    assert unpack(pack(np.array(ids, np.uint32), bits), bits, n, start).tolist() == ids[start : start + n]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(RULES).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r.pattern, fullmatch=True))))
def test_every_match_satisfies_its_trigram_query(case):
    rule, text = case
    low = re.search(rule.pattern, text)[0].lower()
    assert all(any(all(t in low for t in alternative) for alternative in clause) for clause in trigram_query(rule.pattern))


@settings(max_examples=300, deadline=None)
@given(st.text("<>/pbai lns=\"'-!&;\nx", max_size=80))
def test_any_markup_is_read(html):
    assert isinstance(extract_text(html), str)
