"""The rows that the queries of ``word_queries`` must give, as SQL: recorded from a run, then read through against the rules.

A change of these rows is a change of behaviour and has to be justified by a rule.
"""

from __future__ import annotations

from .fixtures import LONG

_S = ("The site diary for the pump station describes the risk matrix of the main batch number ", "The audit trail updates the delivery note for mobile equipment number ")


def _sentences(first: int, last: int) -> str:
    return " ".join(f"{_S[i % 2]}{i}." for i in range(first, last + 1))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in value.split("\n"))
    return str(value)


def _table(columns: str, rows: list[tuple]) -> str:
    """A SELECT of typed rows; columns as ``name TYPE, ...``."""
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in named)
    return f"SELECT {cast} FROM (VALUES\n" + ",\n".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({', '.join(n for n, _ in named)})"


DOCX_ERRORS = [
    ('captions.docx', None, 'Report', 'captions.docx'),
    ('chunks.docx', None, 'Report', 'chunks.docx'),
    ('contents.docx', None, 'Report', 'contents.docx'),
    ('declared.docx', 'PackageError', None, None),
    ('guard.docx', None, 'Report', 'guard.docx'),
    ('headings.docx', None, 'Report', 'headings.docx'),
    ('inline.docx', None, 'Report', 'inline.docx'),
    ('lines.docx', None, 'Report', 'lines.docx'),
    ('lists.docx', None, 'Report', 'lists.docx'),
    ('nozip.docx', 'PackageError', None, None),
    ('running.docx', None, 'Report', 'running.docx'),
    ('tables.docx', None, 'Report', 'tables.docx'),
]
DOCX_ROLES = [
    ('captions.docx', 0, 'caption', None, None, None, 'Table 1 : Sizes'),
    ('captions.docx', 2, 'text', None, None, None, ''),
    ('captions.docx', 3, 'caption', None, None, None, 'Figure 1 - The pump'),
    ('captions.docx', 4, 'caption', None, None, None, 'Loose'),
    ('captions.docx', 5, 'text', None, None, None, 'Figure 9 lies far away'),
    ('captions.docx', 6, 'text', None, None, None, 'LONG'),
    ('contents.docx', 0, 'toc_title', None, None, None, 'Contents'),
    ('contents.docx', 1, 'toc', None, None, None, 'Purpose'),
    ('contents.docx', 2, 'toc', None, None, None, 'Means'),
    ('contents.docx', 3, 'heading', 1, 'toc_anchor', 0.95, 'Purpose'),
    ('contents.docx', 4, 'text', None, None, None, 'LONG'),
    ('contents.docx', 5, 'heading', 2, 'toc_text', 0.85, 'Means'),
    ('contents.docx', 6, 'text', None, None, None, 'LONG'),
    ('guard.docx', 0, 'text', None, None, None, 'Bold line 0'),
    ('guard.docx', 1, 'text', None, None, None, 'Bold line 1'),
    ('guard.docx', 2, 'text', None, None, None, 'Bold line 2'),
    ('guard.docx', 3, 'text', None, None, None, 'Bold line 3'),
    ('guard.docx', 4, 'text', None, None, None, 'LONG'),
    ('guard.docx', 5, 'text', None, None, None, 'LONG'),
    ('guard.docx', 6, 'heading', 1, 'formatting', 0.6, 'Alone in bold'),
    ('guard.docx', 7, 'text', None, None, None, 'LONG'),
    ('headings.docx', 0, 'title', 0, 'style_title', 1.0, 'Report on pumps'),
    ('headings.docx', 1, 'heading', 1, 'outline_level', 1.0, 'Purpose'),
    ('headings.docx', 2, 'text', None, None, None, 'LONG'),
    ('headings.docx', 3, 'heading', 2, 'outline_level', 1.0, 'Detail'),
    ('headings.docx', 4, 'text', None, None, None, 'LONG'),
    ('headings.docx', 5, 'heading', 3, 'style_name', 0.95, 'Kopje'),
    ('headings.docx', 6, 'text', None, None, None, 'LONG'),
    ('headings.docx', 7, 'heading', 2, 'text_numbering', 0.8, '3.2 Typed number'),
    ('headings.docx', 8, 'text', None, None, None, 'LONG'),
    ('headings.docx', 9, 'heading', 1, 'text_numbering', 0.75, 'Chapitre 4 Essais'),
    ('headings.docx', 10, 'text', None, None, None, 'LONG'),
    ('headings.docx', 11, 'heading', 3, 'style_keyword', 0.7, 'Keyword line'),
    ('headings.docx', 12, 'text', None, None, None, 'LONG'),
    ('headings.docx', 13, 'heading', 1, 'formatting', 0.6, 'Looks like one'),
    ('headings.docx', 14, 'text', None, None, None, 'LONG'),
    ('headings.docx', 15, 'text', None, None, None, 'Ends with a stop.'),
    ('headings.docx', 16, 'text', None, None, None, 'LONG'),
    ('headings.docx', 17, 'heading', 1, 'numbering', 0.8, 'First step'),
    ('headings.docx', 18, 'text', None, None, None, 'LONG'),
    ('headings.docx', 19, 'text', None, None, None, 'Last bold line'),
    ('lines.docx', 0, 'toc_title', None, None, None, 'Sommaire'),
    ('lines.docx', 1, 'toc', None, None, None, '1. Part 1'),
    ('lines.docx', 2, 'toc', None, None, None, '2. Part 2'),
    ('lines.docx', 3, 'toc', None, None, None, '3. Part 3'),
    ('lines.docx', 4, 'heading', 1, 'toc_text', 0.85, 'Part 2'),
    ('lines.docx', 5, 'text', None, None, None, 'LONG'),
    ('lines.docx', 6, 'text', None, None, None, 'x ..... 9'),
    ('lines.docx', 7, 'text', None, None, None, 'y ..... 9'),
    ('lines.docx', 8, 'text', None, None, None, 'LONG'),
    ('lists.docx', 0, 'list_item', None, None, None, 'n10'),
    ('lists.docx', 1, 'list_item', None, None, None, 'n11'),
    ('lists.docx', 2, 'list_item', None, None, None, 'n11'),
    ('lists.docx', 3, 'list_item', None, None, None, 'n10'),
    ('lists.docx', 4, 'list_item', None, None, None, 'n11'),
    ('lists.docx', 5, 'list_item', None, None, None, 'n30'),
    ('lists.docx', 6, 'list_item', None, None, None, 'n20'),
    ('lists.docx', 7, 'text', None, None, None, 'LONG'),
    ('lists.docx', 8, 'list_item', None, None, None, 'dash'),
    ('lists.docx', 9, 'list_item', None, None, None, 'dot'),
    ('lists.docx', 10, 'list_item', None, None, None, 'back'),
    ('lists.docx', 11, 'list_item', None, None, None, 'letter'),
    ('lists.docx', 12, 'text', None, None, None, 'LONG'),
    ('lists.docx', 13, 'list_item', None, None, None, 'one'),
    ('lists.docx', 14, 'text', None, None, None, 'LONG'),
    ('running.docx', 0, 'furniture', None, None, None, 'Company report'),
    ('running.docx', 1, 'text', None, None, None, LONG + ' 0'),
    ('running.docx', 2, 'furniture', None, None, None, 'Page 1 / 3'),
    ('running.docx', 3, 'empty', None, None, None, ''),
    ('running.docx', 4, 'furniture', None, None, None, 'Company report'),
    ('running.docx', 5, 'text', None, None, None, LONG + ' 1'),
    ('running.docx', 6, 'furniture', None, None, None, 'Page 2 / 3'),
    ('running.docx', 7, 'empty', None, None, None, ''),
    ('running.docx', 8, 'furniture', None, None, None, 'Company report'),
    ('running.docx', 9, 'text', None, None, None, LONG + ' 2'),
    ('running.docx', 10, 'furniture', None, None, None, 'Page 3 / 3'),
    ('running.docx', 11, 'empty', None, None, None, ''),
    ('running.docx', 12, 'text', None, None, None, 'LONG'),
]
DOCX_LEVELS = [
    ('captions.docx', 0, 'caption', None, None, None, 1),
    ('captions.docx', 3, 'caption', None, None, None, 2),
    ('captions.docx', 4, 'caption', None, None, None, None),
    ('chunks.docx', 8, 'list_item', '1.', None, None, None),
    ('chunks.docx', 9, 'list_item', '1.a)', None, None, None),
    ('contents.docx', 1, 'toc', None, 1, '2', None),
    ('contents.docx', 2, 'toc', None, 2, '3', None),
    ('inline.docx', 0, 'caption', None, None, None, None),
    ('lines.docx', 1, 'toc', None, 1, '1', None),
    ('lines.docx', 2, 'toc', None, 1, '2', None),
    ('lines.docx', 3, 'toc', None, 1, '3', None),
    ('lists.docx', 0, 'list_item', '1.', None, None, None),
    ('lists.docx', 1, 'list_item', '1.a)', None, None, None),
    ('lists.docx', 2, 'list_item', '1.b)', None, None, None),
    ('lists.docx', 3, 'list_item', '2.', None, None, None),
    ('lists.docx', 4, 'list_item', '2.a)', None, None, None),
    ('lists.docx', 5, 'list_item', '5.', None, None, None),
    ('lists.docx', 6, 'list_item', '•', None, None, None),
    ('lists.docx', 8, 'list_item', '-', None, None, None),
    ('lists.docx', 9, 'list_item', '•', None, None, None),
    ('lists.docx', 10, 'list_item', '-', None, None, None),
    ('lists.docx', 11, 'list_item', 'a)', None, None, None),
    ('lists.docx', 13, 'list_item', '1)', None, None, None),
]
DOCX_INLINE = [
    (0, 'Table 1 kept-≥ x yz', 'Normal', 1, 'table', '', '', False),
    (1, 'noted', 'Normal', 1, None, '2', '', False),
    (2, 'again', 'Normal', 1, None, '2', '', False),
    (3, 'anchor', 'Normal', 1, None, '', '', False),
    (4, 'boxed', 'Normal', 1, None, '', '', True),
    (5, 'link there', 'Normal', 1, None, '', 'https://example.org/x', False),
    (6, 'next', 'Normal', 2, None, '', '', False),
    (7, '', 'Normal', 2, None, '', '', False),
    (8, 'c', 'Normal', 3, None, '', '', False),
    (9, 'de', 'Normal', 4, None, '', '', False),
    (10, 'loop', 'loop', 5, None, '', '', False),
]
DOCX_CELLS = [
    (1, 'tblHeader', 0, 0, 0, 1, 1, 'A', True),
    (1, 'tblHeader', 0, 0, 1, 1, 1, 'B', True),
    (1, 'tblHeader', 0, 1, 0, 2, 1, 'x', False),
    (1, 'tblHeader', 0, 1, 1, 1, 1, '1', False),
    (1, 'tblHeader', 0, 2, 1, 1, 1, '2', False),
    (1, 'tblHeader', 0, 3, 0, 1, 2, 'wide', False),
    (5, None, 0, 0, 0, 1, 1, 'a', False),
    (5, None, 0, 0, 1, 1, 1, 'b', False),
    (5, None, 0, 1, 0, 1, 1, 'c', False),
    (5, None, 0, 1, 1, 1, 1, 'd', False),
    (7, 'bold_first_row', 0, 0, 0, 1, 1, 'Head', True),
    (7, 'bold_first_row', 0, 0, 1, 1, 1, 'Size', True),
    (7, 'bold_first_row', 0, 1, 0, 1, 1, 'pump', False),
    (7, 'bold_first_row', 0, 1, 1, 1, 1, '3', False),
    (9, 'tblLook', 0, 0, 0, 1, 1, 'Key', True),
    (9, 'tblLook', 0, 0, 1, 1, 1, 'Value', True),
    (9, 'tblLook', 0, 1, 0, 1, 1, 'k', False),
    (9, 'tblLook', 0, 1, 1, 1, 1, 'v', False),
    (11, None, 1, 0, 0, 1, 1, 'outer\nin 1 | in 2', False),
    (11, None, 1, 0, 1, 1, 1, 'q', False),
    (11, None, 1, 1, 0, 1, 1, 'r', False),
    (11, None, 1, 1, 1, 1, 1, 's', False),
]
DOCX_ITEMS = [
    ('captions.docx', '#/pictures/0', '#/body', 'picture', 'body', None, None, None),
    ('captions.docx', '#/tables/0', '#/body', 'table', 'body', None, None, None),
    ('captions.docx', '#/texts/0', '#/tables/0', 'caption', 'body', 'Table 1 : Sizes', None, None),
    ('captions.docx', '#/texts/1', '#/pictures/0', 'caption', 'body', 'Figure 1 - The pump', None, None),
    ('captions.docx', '#/texts/2', '#/body', 'caption', 'body', 'Loose', None, None),
    ('captions.docx', '#/texts/3', '#/body', 'text', 'body', 'Figure 9 lies far away', None, None),
    ('captions.docx', '#/texts/4', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('contents.docx', '#/groups/0', '#/body', 'list', 'furniture', None, None, None),
    ('contents.docx', '#/texts/0', '#/groups/0', 'text', 'furniture', 'Contents', None, None),
    ('contents.docx', '#/texts/1', '#/groups/0', 'list_item', 'furniture', 'Purpose', None, ''),
    ('contents.docx', '#/texts/2', '#/groups/0', 'list_item', 'furniture', 'Means', None, ''),
    ('contents.docx', '#/texts/3', '#/body', 'section_header', 'body', 'Purpose', 1, None),
    ('contents.docx', '#/texts/4', '#/texts/3', 'text', 'body', 'The site diary for the p', None, None),
    ('contents.docx', '#/texts/5', '#/texts/3', 'section_header', 'body', 'Means', 2, None),
    ('contents.docx', '#/texts/6', '#/texts/5', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/0', '#/body', 'title', 'body', 'Report on pumps', None, None),
    ('headings.docx', '#/texts/1', '#/texts/0', 'section_header', 'body', 'Purpose', 1, None),
    ('headings.docx', '#/texts/10', '#/texts/9', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/11', '#/texts/9', 'section_header', 'body', 'Keyword line', 3, None),
    ('headings.docx', '#/texts/12', '#/texts/11', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/13', '#/texts/0', 'section_header', 'body', 'Looks like one', 1, None),
    ('headings.docx', '#/texts/14', '#/texts/13', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/15', '#/texts/13', 'text', 'body', 'Ends with a stop.', None, None),
    ('headings.docx', '#/texts/16', '#/texts/13', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/17', '#/texts/0', 'section_header', 'body', '1. First step', 1, None),
    ('headings.docx', '#/texts/18', '#/texts/17', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/19', '#/texts/17', 'text', 'body', 'Last bold line', None, None),
    ('headings.docx', '#/texts/2', '#/texts/1', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/3', '#/texts/1', 'section_header', 'body', 'Detail', 2, None),
    ('headings.docx', '#/texts/4', '#/texts/3', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/5', '#/texts/3', 'section_header', 'body', 'Kopje', 3, None),
    ('headings.docx', '#/texts/6', '#/texts/5', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/7', '#/texts/1', 'section_header', 'body', '3.2 Typed number', 2, None),
    ('headings.docx', '#/texts/8', '#/texts/7', 'text', 'body', 'The site diary for the p', None, None),
    ('headings.docx', '#/texts/9', '#/texts/0', 'section_header', 'body', 'Chapitre 4 Essais', 1, None),
    ('lists.docx', '#/groups/0', '#/body', 'list', 'body', None, None, None),
    ('lists.docx', '#/groups/1', '#/texts/0', 'list', 'body', None, None, None),
    ('lists.docx', '#/groups/2', '#/texts/3', 'list', 'body', None, None, None),
    ('lists.docx', '#/groups/3', '#/body', 'list', 'body', None, None, None),
    ('lists.docx', '#/groups/4', '#/texts/8', 'list', 'body', None, None, None),
    ('lists.docx', '#/groups/5', '#/texts/10', 'list', 'body', None, None, None),
    ('lists.docx', '#/groups/6', '#/body', 'list', 'body', None, None, None),
    ('lists.docx', '#/texts/0', '#/groups/0', 'list_item', 'body', 'n10', None, '1.'),
    ('lists.docx', '#/texts/1', '#/groups/1', 'list_item', 'body', 'n11', None, '1.a)'),
    ('lists.docx', '#/texts/10', '#/groups/3', 'list_item', 'body', 'back', None, '-'),
    ('lists.docx', '#/texts/11', '#/groups/5', 'list_item', 'body', 'letter', None, 'a)'),
    ('lists.docx', '#/texts/12', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('lists.docx', '#/texts/13', '#/groups/6', 'list_item', 'body', 'one', None, '1)'),
    ('lists.docx', '#/texts/14', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('lists.docx', '#/texts/2', '#/groups/1', 'list_item', 'body', 'n11', None, '1.b)'),
    ('lists.docx', '#/texts/3', '#/groups/0', 'list_item', 'body', 'n10', None, '2.'),
    ('lists.docx', '#/texts/4', '#/groups/2', 'list_item', 'body', 'n11', None, '2.a)'),
    ('lists.docx', '#/texts/5', '#/groups/0', 'list_item', 'body', 'n30', None, '5.'),
    ('lists.docx', '#/texts/6', '#/groups/0', 'list_item', 'body', 'n20', None, '•'),
    ('lists.docx', '#/texts/7', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('lists.docx', '#/texts/8', '#/groups/3', 'list_item', 'body', 'dash', None, '-'),
    ('lists.docx', '#/texts/9', '#/groups/4', 'list_item', 'body', 'dot', None, '•'),
    ('running.docx', '#/texts/0', '#/furniture', 'page_header', 'furniture', 'Company report', None, None),
    ('running.docx', '#/texts/1', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('running.docx', '#/texts/2', '#/furniture', 'page_footer', 'furniture', 'Page 1 / 3', None, None),
    ('running.docx', '#/texts/3', '#/furniture', 'page_header', 'furniture', 'Company report', None, None),
    ('running.docx', '#/texts/4', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('running.docx', '#/texts/5', '#/furniture', 'page_footer', 'furniture', 'Page 2 / 3', None, None),
    ('running.docx', '#/texts/6', '#/furniture', 'page_header', 'furniture', 'Company report', None, None),
    ('running.docx', '#/texts/7', '#/body', 'text', 'body', 'The site diary for the p', None, None),
    ('running.docx', '#/texts/8', '#/furniture', 'page_footer', 'furniture', 'Page 3 / 3', None, None),
    ('running.docx', '#/texts/9', '#/body', 'text', 'body', 'The site diary for the p', None, None),
]
DOCX_MARKDOWN = [
    ('captions.docx', '| a | b |\n|---|---|\n| c | d |\n\n*Table 1 : Sizes*\n\n![A pump](word/media/image1.png)\n\n*Figure 1 - The pump*\n\n*Loose*\n\nFigure 9 lies far away\n\nLONG'),
    ('chunks.docx', '## Scope\n\n### Short\n\nSmall.\n\n### Other\n\nSmall too.\n\n## Means\n\n' + _sentences(0, 13) + '\n\n| Head | Size |\n|---|---|\n| pump | 3 |\n\n1. one\n\n  1.a) two\n\n> [note] A note.\n\n![A pump](word/media/image1.png)'),
    ('lists.docx', '1. n10\n\n  1.a) n11\n\n  1.b) n11\n\n2. n10\n\n  2.a) n11\n\n5. n30\n\n• n20\n\nLONG\n\n- dash\n\n  • dot\n\n- back\n\n  a) letter\n\nLONG\n\n1) one\n\nLONG'),
    ('tables.docx', 'LONG\n\n| A | B |\n|---|---|\n| x | 1 |\n| x | 2 |\n| wide | wide |\n\nLONG\n\nonly\n\nLONG\n\n| a | b |\n|---|---|\n| c | d |\n\nLONG\n\n| Head | Size |\n|---|---|\n| pump | 3 |\n\nLONG\n\n| Key | Value |\n|---|---|\n| k | v |\n\nLONG\n\n| outer<br>in 1 \\| in 2 | q |\n|---|---|\n| r | s |\n\nLONG'),
]
DOCX_SECTIONS = [
    ('Means', 'heading', '## Means', '#/texts/5', 2, False, False),
    ('Means', 'mixed', '1. one\n  1.a) two\n    [note] A note.\n\n[Figure] Texte alternatif : A pump', '#/groups/0,#/texts/7,#/groups/1,#/texts/8,#/pictures/0', 20, False, True),
    ('Means', 'table', '[Tableau]\n| Head | Size |\n|---|---|\n| pump | 3 |', '#/tables/0', 14, False, False),
    ('Means', 'text', _sentences(0, 4), '#/texts/6', 106, False, False),
    ('Means', 'text', _sentences(12, 13), '#/texts/6', 43, False, False),
    ('Means', 'text', _sentences(4, 8), '#/texts/6', 106, False, False),
    ('Means', 'text', _sentences(8, 12), '#/texts/6', 107, False, False),
    ('Scope', 'text', '## Scope\n\n### Short\n\nSmall.\n\n### Other\n\nSmall too.', '#/texts/0,#/texts/1,#/texts/2,#/texts/3,#/texts/4', 13, True, False),
]
DOCX_CHUNKS = [
    ('chunks', 'Means', 'figure', 0, 'A pump', 2, 10),
    ('chunks', 'Means', 'table', 0, 'Head : pump ; Size : 3', 9, 16),
    ('chunks', 'Means', 'text', 0, _sentences(0, 1), 37, 45),
    ('chunks', 'Means', 'text', 0, _sentences(8, 9), 37, 45),
    ('chunks', 'Means', 'text', 0, 'for mobile equipment number 13. 1. one\n1.a) two\n\nA note.', 14, 22),
    ('chunks', 'Means', 'text', 0, 'number 1. ' + _sentences(2, 3), 40, 48),
    ('chunks', 'Means', 'text', 0, 'number 11. ' + _sentences(12, 13), 40, 48),
    ('chunks', 'Means', 'text', 0, 'number 3. ' + _sentences(4, 5), 40, 48),
    ('chunks', 'Means', 'text', 0, 'number 5. ' + _sentences(6, 7), 40, 48),
    ('chunks', 'Means', 'text', 0, 'number 9. ' + _sentences(10, 11), 40, 48),
    ('chunks', 'Scope', 'text', 0, 'Short\n\nSmall.\n\nOther\n\nSmall too.', 6, 14),
    ('tables', '', 'table', 0, 'A : x ; B : 1', 9, 14),
    ('tables', '', 'table', 0, 'A : x ; B : 2', 9, 14),
    ('tables', '', 'table', 0, 'Head : pump ; Size : 3', 9, 14),
    ('tables', '', 'table', 0, 'Key : k ; Value : v', 9, 14),
    ('tables', '', 'table', 0, 'a : c ; b : d', 9, 14),
    ('tables', '', 'table', 0, 'outer\nin 1 | in 2 : r ; q : s', 15, 20),
    ('tables', '', 'text', 0, LONG, 22, 27),
    ('tables', '', 'text', 0, 'main batch in full. only ' + LONG, 28, 33),
    ('tables', '', 'text', 0, 'the main batch in full. ' + LONG, 28, 33),
    ('tables', '', 'text', 0, 'the main batch in full. ' + LONG + '\n\nonly', 29, 35),
]
DOCX_PARENTS = [
    ('chunks', 'Means', 0, 'A pump', 2),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(0, 1), 39),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(10, 11), 39),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(12, 13) + '\n\n1. one\n1.a) two\n\nA note.', 46),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(2, 3), 39),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(4, 5), 39),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(6, 7), 39),
    ('chunks', 'Means', 0, 'Means\n\n' + _sentences(8, 9), 39),
    ('chunks', 'Means', 0, '| Head | Size |\n|---|---|\n| pump | 3 |', 14),
    ('chunks', 'Scope', 0, 'Scope\n\nShort\n\nSmall.\n\nOther\n\nSmall too.', 7),
    ('tables', '', 0, LONG, 22),
    ('tables', '', 0, LONG + '\n\n' + LONG, 44),
    ('tables', '', 0, LONG + '\n\n' + LONG, 44),
    ('tables', '', 0, LONG + '\n\n' + LONG + '\n\nonly', 45),
    ('tables', '', 0, '| A | B |\n|---|---|\n| x | 1 |\n| x | 2 |\n| wide |  |', 26),
    ('tables', '', 0, '| Head | Size |\n|---|---|\n| pump | 3 |', 14),
    ('tables', '', 0, '| Key | Value |\n|---|---|\n| k | v |', 14),
    ('tables', '', 0, '| a | b |\n|---|---|\n| c | d |', 14),
    ('tables', '', 0, '| outer<br>in 1 \\| in 2 | q |\n|---|---|\n| r | s |', 19),
]
IMAGE_ELIGIBLE = [
    ('a', '#/pictures/0', 's1'),
    ('a', '#/pictures/3', 's4'),
    ('a', '#/pictures/9', 's1'),
    ('b', '#/pictures/0', 'logo'),
    ('c', '#/pictures/0', 'logo'),
    ('d', '#/pictures/0', 'logo'),
]
IMAGE_FIRST_USES = [
    ('a', 's1', '#/pictures/0', 'm/1.png'),
    ('a', 's4', '#/pictures/3', 'm/4.png'),
    ('b', 'logo', '#/pictures/0', 'm/6.png'),
    ('c', 'logo', '#/pictures/0', 'm/6.png'),
    ('d', 'logo', '#/pictures/0', 'm/6.png'),
]
IMAGE_DESCRIBED = [
    ('logo', None, 'error'),
    ('s1', '5 bytes of image/png', 'described'),
    ('s2', 'another image', 'cached'),
    ('s4', None, 'skipped'),
]
IMAGE_STATISTICS = [
    ('a', 2, 1, 3, 4),
    ('b', 0, 0, 1, 0),
    ('c', 0, 0, 1, 0),
    ('d', 0, 0, 1, 0),
]

SQL = {
    "docx_errors": _table("path VARCHAR, error VARCHAR, title VARCHAR, filename VARCHAR", DOCX_ERRORS),
    "docx_roles": _table("path VARCHAR, pos INTEGER, role VARCHAR, level INTEGER, source VARCHAR, confidence DOUBLE, text VARCHAR", DOCX_ROLES),
    "docx_levels": _table("path VARCHAR, pos INTEGER, role VARCHAR, marker VARCHAR, toc_level INTEGER, toc_page VARCHAR, target INTEGER", DOCX_LEVELS),
    "docx_inline": _table("pos INTEGER, text VARCHAR, style VARCHAR, page INTEGER, seq VARCHAR, notes VARCHAR, links VARCHAR, in_textbox BOOLEAN", DOCX_INLINE),
    "docx_cells": _table("pos INTEGER, header_source VARCHAR, nested INTEGER, row INTEGER, col INTEGER, rows INTEGER, cols INTEGER, text VARCHAR, header BOOLEAN", DOCX_CELLS),
    "docx_items": _table("path VARCHAR, self_ref VARCHAR, parent VARCHAR, label VARCHAR, layer VARCHAR, begins VARCHAR, level INTEGER, marker VARCHAR", DOCX_ITEMS),
    "docx_markdown": _table("path VARCHAR, markdown VARCHAR", DOCX_MARKDOWN),
    "docx_sections": _table("heading_path VARCHAR, kind VARCHAR, text VARCHAR, refs VARCHAR, token_count INTEGER, first BOOLEAN, last BOOLEAN", DOCX_SECTIONS),
    "docx_chunks": _table("doc_id VARCHAR, section VARCHAR, block_type VARCHAR, page INTEGER, text VARCHAR, n_tokens INTEGER, n_tokens_indexed INTEGER", DOCX_CHUNKS),
    "docx_parents": _table("doc_id VARCHAR, section VARCHAR, page INTEGER, text VARCHAR, n_tokens INTEGER", DOCX_PARENTS),
    "image_eligible": _table("doc_id VARCHAR, self_ref VARCHAR, sha256 VARCHAR", IMAGE_ELIGIBLE),
    "image_first_uses": _table("doc_id VARCHAR, sha256 VARCHAR, self_ref VARCHAR, part VARCHAR", IMAGE_FIRST_USES),
    "image_described": _table("sha256 VARCHAR, text VARCHAR, state VARCHAR", IMAGE_DESCRIBED),
    "image_statistics": _table("doc_id VARCHAR, described BIGINT, cached BIGINT, errors BIGINT, skipped BIGINT", IMAGE_STATISTICS),
}
