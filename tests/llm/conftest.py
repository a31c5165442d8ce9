import pytest

pytest.importorskip("quadmill.llm")
