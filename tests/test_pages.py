"""Compiled pages, as whole texts."""

from corpusloom.operators import wiki

A = "The first rule of the house is plain to see. Every guest signs the book at the door."
B = 'A second "part" tells of fees and of their dates. Short.'


def test_a_page_in_full(spark):
    docs = spark.createDataFrame([(1, 'House "rules"', "rules.md", "test"), (2, None, "empty.pdf", None)], "doc_id long, title string, filename string, scope string")
    chunks = spark.createDataFrame([(1, 0, 3, A), (1, 1, None, B + " " * 3 + "x" * 900)], "doc_id long, chunk_index int, page int, content string")
    pages = {r["doc_id"]: r for r in wiki.render_pages(docs, chunks, "2024-01-01").collect()}
    first = ["The first rule of the house is plain to see.", "Every guest signs the book at the door."]
    clipped = f"{B} {'x' * (700 - len(B) - 1)}…"
    second = 'A second "part" tells of fees and of their dates.'
    body = pages[1]["body"]
    assert pages[1]["slug"] == "house-rules"
    assert body.startswith('---\ntitle: "House \\"rules\\""\ntype: source\nsource_document_id: "1"\nknowledge_scope: "test"\ncompiler_version: "rules-2"\nprompt_version: "derived-1"\nconfidence: 0.75\nsource_chunk_count: 2\ncompiled_at: "2024-01-01"\n---\n\n# House "rules"\n\n> ')
    assert f"## Summary\n- {first[0]} [S1]\n- {first[1]} [S1]\n- {second} [S2]\n" in body
    assert f"## Key facts\n- {first[0]} [S1]\n- {second} [S2]\n\n## Notes\n- Page type: source\n- Document: House \"rules\"\n- Scope: test\n- Compiler: rules-2\n" in body
    assert f"## Excerpts\n\n### [S1] chunk 0 · page 3\n{A}\n\n### [S2] chunk 1 · no page\n{clipped}\n\n## Sources\n- [S1] Document: House \"rules\"; Document id: `1`; chunk 0; page 3.\n- [S2] Document: House \"rules\"; Document id: `1`; chunk 1; no page.\n\n## Evidence\n- Document: House \"rules\"\n- Document id: `1`\n- File: `rules.md`\n" in body
    empty = pages[2]["body"]
    assert 'title: "empty.pdf"' in empty and "- Not enough text for a summary." in empty and "- No facts were found." in empty and "source_chunk_count: 0\n" in empty and "confidence: 0.74\n" in empty


def test_derived_pages_in_full(spark):
    docs = spark.createDataFrame([(1, "House", "h.md", None)], "doc_id long, title string, filename string, scope string")
    chunks = spark.createDataFrame([(1, 0, 3, A), (1, 1, 4, A), (1, 2, None, B)], "doc_id long, chunk_index int, page int, content string")
    derived = spark.createDataFrame([(1, "rule", 1, 1), (1, "rule", 0, 2), (1, "process", 2, 1)], "doc_id long, page_type string, chunk_index int, k int")
    pages = {r["page_type"]: r for r in wiki.render_derived(docs, chunks, derived, "2024-01-01").collect()}
    one, two = "The first rule of the house is plain to see.", "Every guest signs the book at the door."
    facts = f"- {one} [S1]\n- {two} [S1]\n- {one} [S2]\n- {two} [S2]"
    assert pages["rule"]["slug"] == "house-rule" and pages["rule"]["summary"] == f"{one} {two}"
    assert pages["rule"]["body"].endswith(
        f"# House rule\n\n> Extracted by rules from [[House|house]].\n\n## Summary\n{facts}\n\n## Key facts\n{facts}\n\n## Related pages\n- [[House|house]]\n- [[House process|house-process]]\n\n## Sources\n- [S1] Document: House; Document id: `1`; chunk 1; page 4.\n- [S2] Document: House; Document id: `1`; chunk 0; page 3.\n"
    )
    assert "type: rule\n" in pages["rule"]["body"] and "confidence: 0.68\nsource_chunk_count: 2\n" in pages["rule"]["body"] and 'knowledge_scope: "production"' in pages["rule"]["body"]
