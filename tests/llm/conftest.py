import pytest

pytest.importorskip("knitwork.llm")
