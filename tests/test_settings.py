import pytest

from parley.errors import SettingsError
from parley.settings import load_settings, read_dotenv


def test_key_is_required_and_not_empty():
    for env in ({}, {"OPENAI_API_KEY": ""}):
        with pytest.raises(SettingsError):
            load_settings(env, dotenv=None)


def test_defaults_and_empty_document():
    s = load_settings({"OPENAI_API_KEY": "k"}, dotenv=None)
    assert (s.document, s.base_url, s.timeout_s, s.max_retries, s.temperature) == ("sample.md", None, 60.0, 0, 0.0)
    assert load_settings({"OPENAI_API_KEY": "k", "MD_FILE": ""}, dotenv=None).document == ""
    assert "k" not in repr(load_settings({"OPENAI_API_KEY": "kkkk"}, dotenv=None)).replace("api_key", "").split("(")[1][:6]


def test_dotenv(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# note\nexport A=1\nB = 'two words'\nC=3 # three\nD\nOPENAI_API_KEY=from-file\n")
    assert read_dotenv(file) == {"A": "1", "B": "two words", "C": "3", "OPENAI_API_KEY": "from-file"}
    assert load_settings({}, file).api_key == "from-file"
    assert load_settings({"OPENAI_API_KEY": "from-env"}, file).api_key == "from-env"
    assert read_dotenv(tmp_path / "none") == {}
