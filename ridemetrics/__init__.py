"""Bike-share analytics on Spark: ride reports and live station status."""
