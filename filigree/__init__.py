"""filigree: document analytics and retrieval over structured filings, on PySpark."""
