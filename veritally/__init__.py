"""Document matching analytics on Spark: catalog, matching, verification and ledger operators."""
