"""docintake: document intake and record extraction as PySpark DataFrame operators."""
