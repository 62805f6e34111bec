"""functions of the contact-data engine."""
