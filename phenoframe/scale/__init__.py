"""Building blocks that keep plans whole and bounded when one key holds most of the rows."""
