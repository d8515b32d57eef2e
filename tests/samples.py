"""Documents written for the tests."""

GUIDE = """---
title: Guide
---

# Running the press

The press needs paper, ink and patience; this part says how they come together on a normal day of printing.

## Paper

Sheets are kept flat and dry for a day before they are used, as damp sheets stick to the rollers and tear at the edges.

### Sizes

Folio, quarto and octavo are cut from one sheet by folding it once, twice or three times along the longer side.

## Ink

```sh
# not a heading
mix --oil 3 --soot 1
```

# Cleaning
Wash the type with lye after each run and rinse it twice, then let it dry in the rack by the window.
"""

SETEXT = """The title of it
===============

Some words below the title that belong to it alone.

Second part
-----------

- item
---
> quote
---

| a | b |
---

## Same
first
## Same
second
## Closed ###
~~~~
# inside
~~~
still inside
~~~~
``a ` b``
## Last
"""

PAGED = """<!-- page:1 -->
## Page 1

# Report

Income rose by a tenth, mostly from sheets and bindings sold abroad.

-- page 2 --
## Page 2

## Costs

Costs stayed flat.

page 3

## Outlook

Growth will slow.
"""

REDIRECT = "# Old place\n\nThis page has moved to [the guide](../a/guide.md#top).\n"
STUB = "# Todo\n\nComing soon.\n"
INDEX = "# Index\n\n" + "".join(f"- [Chapter {k}](./c{k}.md)\n" for k in range(8))
DENSE = "# Links\n\n" + "".join(f"Chapter {k} tells at some length how presses were built and sold in town number {k}: [more](./c{k}.md).\n" for k in range(6))
FLAT = "\n".join(f"Line {k} of a text without any heading at all, just words." for k in range(1, 25)) + "\n"
LONG = "# Table\n\n## Entries\n" + "\n".join(f"- entry {k} with a short text" for k in range(40)) + "\n\n## End\nDone with it.\n"

ALL = {
    "a/guide.md": GUIDE,
    "a/setext.md": SETEXT,
    "b/paged.md": PAGED,
    "b/old.md": REDIRECT,
    "b/stub.md": STUB,
    "b/index.md": INDEX,
    "b/dense.md": DENSE,
    "c/flat.md": FLAT,
    "c/long.md": LONG,
}
