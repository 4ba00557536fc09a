"""Code-quality findings over many repositories, as Spark jobs."""

__version__ = "0.1.0"
