"""Sample files and small helpers of several test modules."""

import base64

THEME = """
pub:
  journal: "Journal of Tests & Trials"
  issn: "1234-5678"
  publisher: "Test House"
  license: "CC-BY 4.0"
  license-url: "https://creativecommons.org/licenses/by/4.0/"
ojs:
  journal-path: "jtt"
  section-ref: "ART"
footer-template: "{journal}, {year}, vol {volume}, {doi}"
"""

REGISTRY = """
date: 2025-01-15
pub:
  volume: 1
  year: 2025
  article-id: "JT.1"
  doi: "10.1234/JT.1"
  article-type: "Editorial"
  discipline: "Psychology"
  lay-summary: >
    A plain summary.
  recommended-citation: "Doe, J. (2025). A title."
  badges:
    open-data: true
    open-code: true
    open-materials: true
    preregistered: false
    reprocert-ai: true
    reprocert-human: true
  badge-links:
    reprocert: "https://x.test/r"
    openreview: ""
"""

ARTICLE = """---
title: "A *title*"
author:
  - name: { given: Jane, family: Doe }
    orcid: 0000-0000-0000-0000
    email: jane@x.test
    corresponding: true
    affiliations: [{ ref: b }, { ref: nowhere }, { name: Inline Lab }]
  - name: "John Q. Public"
    affiliations: [a]
  - just text
affiliations:
  - { id: a, name: "First" }
  - not a map
  - { id: b, name: "Second" }
  - { id: a, name: "First again" }
abstract: >
  Some   abstract.
keywords: [one, two]
bibliography: references.bib
lang: en-GB
---

Intro with mail me@x.test and `@code`.

# Start

See [see @doe2020; @roe2021, p. 3] and @undefined.

```
# not a heading @nokey
```

## Part {.unnumbered}

![A](figures/media/a.emf){width=1} ![B](figures/gone.png)
"""

BIB = """@article{doe2020,
  author = {Doe, Jane and Roe, Richard},
  title = {A {B}raced title},
  year = {2020},
  month = apr,
  doi = {https://doi.org/10.1/ABC}
}

@ARTICLE{roe2021,
AUTHOR={Roe, Richard and Doe, Jane and {The and Co}},
TITLE="Quoted, with comma",
 DATE={2021-05-01}
}
@misc{unused, title = {Never cited}, author = {Ann Example}}
"""

JATS = (
    "<?xml version='1.0'?><article article-type=\"other\" xmlns:xlink=\"http://www.w3.org/1999/xlink\"><front>"
    "<journal-meta></journal-meta><article-meta><title-group><article-title>T</article-title></title-group>"
    "<kwd-group><kwd>k</kwd></kwd-group></article-meta></front><body/></article>"
)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(text, bytes):
        path.write_bytes(text)
    else:
        path.write_text(text, encoding="utf-8")


def decoded(text):
    return base64.b64decode(text)
