"""Analytics over financial facts from spreadsheets, as Spark plans."""
