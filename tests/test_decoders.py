"""Decoders that a backend cannot apply are errors."""

from __future__ import annotations

import pytest

from casebook.operators import extraction


@pytest.mark.parametrize("name", ["local", "HF", "echo", "replay", "sglang", "ollama"])
@pytest.mark.parametrize("decoder", ["schema", "outlines", "guidance"])
def test_a_decoder_is_refused_where_nothing_would_apply_it(name, decoder):
    with pytest.raises(ValueError, match="needs one of"):
        extraction.decoder(decoder, name, "v5")
    assert extraction.decoder("none", name, "v5") is None


def test_local_generation_refuses_a_schema():
    with pytest.raises(NotImplementedError):
        extraction.backend("local", model="m").generate("p", {"type": "object"})


@pytest.mark.parametrize("name", ["http", "vllm"])
def test_an_endpoint_is_sent_the_schema(name):
    schema = extraction.decoder("schema", name, "v5")
    assert extraction.backend(name).request("p", schema)["response_format"]["json_schema"]["schema"] == schema
