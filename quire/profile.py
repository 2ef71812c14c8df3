"""Names and fixed values of the manuscript format."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values of the manuscript format ---------------------------------

SOURCE_SUFFIXES = (".qmd", ".md", ".rmd", ".docx", ".doc", ".tex")
ARCHIVE_SUFFIX = ".zip"
OFFICE_LOCK_PREFIX = "~$"
METAFILE_SUFFIXES = (".emf", ".wmf")
MAIN_FILE_NAMES = ("main.tex", "manuscript.tex", "article.tex")
DOCUMENT_START = "\\begin{document}"
SOURCE_PLACEHOLDER = "PUT_MANUSCRIPT_HERE.md"

CANONICAL_NAME = "article.qmd"
REGISTRY_NAME = "_metadata.yml"
THEME_NAME = "theme.yml"
BIBLIOGRAPHY_NAME = "references.bib"

ARTICLE_TYPES = (
    "Editorial", "Replication", "Reproduction", "Methods", "Comment", "Review", "Tutorial",
)

# (file name, label, genre, media type); the position is the file id
GALLEYS = (
    ("article.pdf", "PDF", "Article Text", "application/pdf"),
    ("article.html", "HTML", "Article Text", "text/html"),
    ("article.xml", "JATS XML", "Article Text", "application/xml"),
)

# display order: (key, label, PNG file, SVG-page file)
BADGES = (
    ("preregistered", "Preregistered", "preregestered.png", "preregestered.png"),
    ("open-materials", "Open Materials", "openmaterial.png", "openmaterial.png"),
    ("open-data", "Open Data", "opendata.png", "opendata.png"),
    ("open-code", "Open Code", "opencode.png", "opencode.png"),
    ("codecheck", "CODECHECK", "codecheck.png", "codecheck.svg"),
    ("reprocert-hai", "Reproducibility Certified (Human & AI)", "reprocert_hai.png", "reprocert_hai.svg"),
    ("reprocert-ai", "Reproducibility Certified (AI)", "reprocert_ai.png", "reprocert_ai.svg"),
    ("reprocert-human", "Reproducibility Certified (Human)", "reprocert_human.png", "reprocert_human.svg"),
    ("openreview", "Open Peer Review", "openreview.png", "openreview.svg"),
)
# badges whose masthead icon links to a report
LINKED_BADGES = ("preregistered", "codecheck", "reprocert", "openreview")

DEFAULT_HOMEPAGE = "#"
DEFAULT_LICENSE = "CC-BY 4.0"
DEFAULT_ACCENT = "009CCF"
DEFAULT_CARD_BACKGROUND = "FEFDF6"
DEFAULT_CARD_BORDER = "EAE8DF"
DEFAULT_LOCALE = "en"
DEFAULT_SECTION = "ART"
DEFAULT_USER_GROUP = "Author"
DEFAULT_UPLOADER = "admin"
DEFAULT_ARTICLE_ID = "article"
DEFAULT_JOURNAL_PATH = "journal"

NO_AUTHORS = "No authors found (front matter 'author:' is empty)."
NO_EMAIL = (
    "No author has an email; OJS requires at least the corresponding author's email for import."
)
NO_BIBLIOGRAPHY = (
    "No bibliography detected. If the manuscript cites sources, add a references.bib "
    "(Word citations must use live Zotero/Mendeley field codes to be extracted automatically)."
)
NO_GALLEYS = "No rendered galleys found — run quarto render first."

SKELETON_FRONT_MATTER = """title: "TODO: article title"
author:
  - name: { given: TODO, family: TODO }
    email: ""
    corresponding: true
    affiliations: [{ ref: aff1 }]
affiliations:
  - { id: aff1, name: "TODO: affiliation" }
abstract: >
  TODO: abstract (paste here if it was not detected automatically).
keywords: [TODO]
bibliography: references.bib"""

# Pandoc's whitespace (Unicode, plus the four ASCII separators)
WHITESPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# the outer ranges rule most characters out by two comparisons
WHITESPACE = r"[\t-\x20\x85-\u3000&&[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"

# --- names a journal chooses for itself -------------------------------------


@dataclass(frozen=True)
class Profile:
    """The names one publisher uses; everything else is the same everywhere.

    ``namespace`` is the top-level metadata key that holds the publication
    fields (volume, year, badges, ...). ``abstract_macro`` is the LaTeX macro
    that wraps the abstract. ``project_links`` are the theme's extra link
    fields with their fall-backs, used by the closing lines of an article.
    """

    namespace: str = "pub"
    abstract_macro: str = "PubAbstract"
    keywords_macro: str = "keywords"
    citation_macro: str = "recommendedcitation"
    project_links: tuple[tuple[str, str], ...] = ()

    @property
    def required(self) -> tuple[tuple[str, str], ...]:
        """(dotted path, label) of the fields an article cannot go without."""
        plain = (("title", "article title"), ("abstract", "abstract"), ("keywords", "keywords"))
        owned = ("volume", "year", "article-id", "article-type", "discipline", "journal")
        return plain + tuple((f"{self.namespace}.{f}", f"{self.namespace}.{f}") for f in owned)

    @property
    def recommended(self) -> tuple[tuple[str, str], ...]:
        ns = self.namespace
        return (
            (f"{ns}.doi", f"{ns}.doi (DOI)"),
            (f"{ns}.lay-summary", f"{ns}.lay-summary (plain-language summary)"),
            (f"{ns}.recommended-citation", f"{ns}.recommended-citation"),
        )
