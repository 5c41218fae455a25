"""The checking SQL must be readable where Spark's jars, or Spark itself, are not."""

import subprocess
import sys
from pathlib import Path

from pyspark.ml.feature import StopWordsRemover

from braidsearch.functions.text import LANGUAGES, stop_words

HERE = Path(__file__).parent.parent


def test_oracles_need_no_spark():
    code = (
        "import sys; sys.modules['pyspark'] = None; import oracles; found = oracles.built();"
        "assert set(found) == set(oracles.ORACLES) and all(found.values()), found"
    )
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True)


def test_one_broken_oracle_does_not_hide_the_rest(monkeypatch, capsys):
    import oracles

    monkeypatch.setitem(oracles.ORACLES, "broken", lambda: 1 / 0)
    found = oracles.built()
    assert "broken" not in found and "doc_freq" in found
    assert "broken" in capsys.readouterr().err


def test_stop_words_are_those_of_spark(spark):
    for code, language in LANGUAGES.items():
        assert list(stop_words(code)) == StopWordsRemover.loadDefaultStopWords(language)
