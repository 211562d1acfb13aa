"""paddock: vehicle-plate sighting analytics on Spark."""
