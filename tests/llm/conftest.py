from conftest_llm import make_docs, odd_rows  # noqa: F401
