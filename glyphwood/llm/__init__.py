"""Training-data operators over text tables. Nothing outside this subpackage imports it.

Conventions shared by all operators of this subpackage:

* they select the columns that they need by name, so further columns of any name do no harm;
* a null text counts as an empty text and a null id is carried as it is;
* repeated rows are separate documents and give separate rows;
* an empty table gives an empty result of the same schema.
"""
