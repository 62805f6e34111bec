"""streaming of the contact-data engine."""
