import io
import zipfile

import pytest

from helpers import ARTICLE, BIB, JATS, REGISTRY, THEME, write
from quire.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="8", partitions=4, memory="4g", name="quire-tests")


@pytest.fixture(scope="session")
def root(tmp_path_factory):
    """Three manuscripts: complete, almost empty, and a zipped LaTeX upload."""
    root = tmp_path_factory.mktemp("corpus")
    write(root / "themes/jtt/theme.yml", THEME)
    good = root / "manuscripts/JT.1"
    write(good / "_metadata.yml", REGISTRY)
    write(good / "article.qmd", ARTICLE.replace("\n", "\r\n"))
    write(good / "references.bib", BIB)
    write(good / "article.xml", JATS)
    write(good / "article.pdf", b"%PDF" + bytes(200))
    write(good / "figures/media/a.emf", b"x")
    write(good / "figures/unused.png", b"x")
    write(good / "source/PUT_MANUSCRIPT_HERE.md", "placeholder")
    bad = root / "manuscripts/bad one"
    write(bad / "_metadata.yml", "pub: { volume: 0, badges: {} }\n")
    write(bad / "article.qmd", "---\ntitle: T\nauthor: Jane Doe\nbibliography: [lost.bib]\n---\nno newline after the end ---")
    write(bad / "source/~$draft.docx", "lock")
    packed = root / "manuscripts/zip"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("parts/long.tex", "x" * 500)
        archive.writestr(
            "paper.tex",
            "\\begin{document}\\PubAbstract{An {inner}  \\emph{word}\n here}\\keywords{a; b ,c}\\keywords{no}\\end{document}",
        )
        archive.writestr("parts/refs.bib", BIB)
    write(packed / "source/export.zip", buffer.getvalue())
    write(packed / "_metadata.yml", "- not\n- a map\n")
    return str(root)
