"""sparkloom: tensor analytics, plan checks and evaluation scoring as Spark DataFrame plans."""
