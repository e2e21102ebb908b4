"""quernstone: document retrieval analytics and corpus preparation on PySpark."""
