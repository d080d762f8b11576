import logging

import pytest

from leafmill import config


def test_round_trip_and_defaults(tmp_path):
    p = tmp_path / "c.yaml"
    c = config.Config()
    c.pipeline.pages = "1-5"
    c.write(p)
    assert config.Config.read(p) == c
    assert config.load(tmp_path / "none.yaml").enhancement.denoise_strength == 10.0
    assert list(c.__dataclass_fields__) == ["api", "extraction", "enhancement", "ocr", "diagram", "pipeline"]


def test_empty_file(tmp_path):
    (tmp_path / "c.yaml").write_text("")
    assert config.load(tmp_path / "c.yaml") == config.Config()


@pytest.mark.parametrize("values", [
    {"other": {}}, {"ocr": {"nothing": 1}}, {"ocr": {"ensemble_strategy": "all"}}, {"ocr": {"engine_priority": ["x"]}}, {"pipeline": {"workers": "two"}}, {"pipeline": {"workers": True}}, {"extraction": {"text_extract_mode": 3}},
])
def test_values_that_cannot_be(values):
    with pytest.raises(config.ConfigError):
        config.Config.of(values)


def test_numbers_and_nulls():
    c = config.Config.of({"enhancement": {"denoise_strength": 3, "sr_gpu_id": None}, "pipeline": {"pages": None}})
    assert c.enhancement.denoise_strength == 3 and c.enhancement.sr_gpu_id is None


def test_warning_only_with_a_section_that_lacks_the_key(caplog, monkeypatch):
    monkeypatch.delenv("ANTHROPIC_API_KEY", raising=False)
    with caplog.at_level(logging.WARNING):
        config.Config.of({})
        assert not caplog.records
        config.Config.of({"api": {}})
        assert len(caplog.records) == 1
        config.Config.of({"api": {"anthropic_api_key": "k"}})
        assert len(caplog.records) == 1
