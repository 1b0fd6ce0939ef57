"""Time-stepped, coupled processes over keyed tables, as Spark plans."""
